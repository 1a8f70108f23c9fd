"""Packing of tokenized texts into sequences by vector best fit.

A piece costs its tokens, one document, and attention, the square of its tokens.
A sequence has a capacity of each. Pieces go largest first to the sequence that
fits best among those with room in every dimension: where the weighted norm of
what is left is least, or where the weighted dot product of what is left with
the piece is highest.

*What the driver sees.* Pieces of one length cost the same and are
interchangeable, and so are sequences that hold the same lengths. So the packer
works on the histogram of lengths, at most ``tokens`` rows whatever the corpus,
and on classes of like sequences, runs of consecutive numbers of which each
length splits at most one. It places all pieces of a length into all sequences
of a class in one step and gives what placing them one by one would give. Which
piece goes where follows from its number among those of its length, which is
taken in hashed cells.

*Tokens.* Word-level BPE never joins characters across white space, nor letters,
digits and punctuation of ASCII with each other, but for apostrophes. So texts
are cut into such runs, some megabytes at a time, each distinct run is tokenized
once in a worker, and a text's ids are put together. Where a text holds the beginning
of a special token's name, it is tokenized as a whole. A test holds the ids
against those of the whole text.

Defined cases: a null text is empty and has the end id alone; every text is
whole, and only one with more tokens than a sequence holds is cut, into full
pieces and what is left; a piece that alone is beyond the capacity of attention
has a sequence of its own; rows that repeat are packed one by one; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import itertools
import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gapless_slots, materialize

#: A worker forgets the runs that it knows beyond so many runs or ids, and reads texts by so many bytes.
KNOWN_WORDS, KNOWN_IDS, CHUNK = 300_000, 2_000_000, 2_000_000
#: Runs that are tokenized in one call, with this special token between them.
AT_ONCE, BETWEEN, MARK = 500, "<|startoftext|>", b"<|"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Kinds of bytes in lower case: white space, letters, digits, punctuation (all of ASCII, no apostrophe), and any other.
_KIND = np.full(256, 4, np.uint8)
for _kind, _bytes in enumerate((b" \t\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")):
    _KIND[list(_bytes)] = _kind
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The values of all spans, one span after the other."""
    ends = np.cumsum(lengths)
    return values[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]


def _runs(data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The runs of texts in lower case that begin at ``at``, and how many there are up to each text's end.

    A run ends at white space and between letters, digits and punctuation.
    """
    kind = _KIND[data]
    told = kind > 0
    begins = np.ones(len(data), bool)
    begins[1:] = (kind[1:] != kind[:-1]) & (~told[:-1] | ((kind[1:] | kind[:-1]) < 4))
    begins[at[:-1][at[:-1] < len(data)]] = True
    begins &= told
    offsets = np.append(np.flatnonzero(begins[told]), np.count_nonzero(told))
    runs = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data[told])])
    return runs, np.searchsorted(np.flatnonzero(begins), at[1:])


class WordIds:
    """The ids of runs, and of texts that are tokenized as a whole; ``None`` stands for the end of a text."""

    def __init__(self, path: str, end: int) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks run beside each other already
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.end = Tokenizer.from_file(path), end
        self.between = self.tokenizer.token_to_id(BETWEEN)
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        #: Whether case and white space are dropped and words tokenized by themselves; if not, texts are tokenized whole.
        self.by_word = ids("Ab, C") == ids("ab") + ids(",") + ids("c")
        #: Words of a to z are as they are before the model, which marks the last token of each.
        self.model, suffix = Tokenizer(self.tokenizer.model), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.closes = np.array([bool(suffix) and (self.model.id_to_token(i) or "").endswith(suffix) for i in range(self.model.get_vocab_size())])
        self.marks = bool(self.closes.any())
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes | None, int] = {None: 0}
        self.starts, self.lengths, self.ids = np.zeros(1, np.int64), np.ones(1, np.int64), np.array([self.end], "<u4")

    def _add(self, words: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.number.update(zip(words, range(len(self.lengths), len(self.lengths) + len(words)), strict=True))
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(lengths) - lengths))
        self.lengths, self.ids = np.concatenate((self.lengths, lengths)), np.concatenate((self.ids, ids))

    def _encode_plain(self, words: list[bytes]) -> None:
        """Learn words of a to z, which need the model alone."""
        texts = [" ".join(map(bytes.decode, words[i : i + 50])) for i in range(0, len(words), 50)]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in self.model.encode_batch_fast(texts, add_special_tokens=False)])
        self._add(words, ids, np.diff(np.flatnonzero(self.closes[ids]) + 1, prepend=0))

    def _encode(self, words: list[bytes], at_once: int) -> None:
        """Learn words as they are, so many in one call, with a special token between them."""
        if not words:
            return
        at_once = at_once if self.between is not None else 1
        texts = [BETWEEN.join(map(bytes.decode, words[i : i + at_once])) for i in range(0, len(words), at_once)]
        found = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids, ends = np.concatenate(found), np.cumsum([len(x) for x in found])
        if at_once == 1:
            return self._add(words, ids, np.diff(ends, prepend=0))
        # A word ends where the special token stands, or at the end of a call.
        cuts = np.flatnonzero(ids == self.between)
        behind = np.sort(np.concatenate((cuts, ends - 0.5)))  # an empty last word ends there as well
        counts = np.diff(np.ceil(behind).astype(np.int64), prepend=0)
        counts[1:] -= behind[:-1] == np.floor(behind[:-1])  # less the special token before it
        self._add(words, np.delete(ids, cuts), counts)

    def learn(self, runs: list[bytes]) -> None:
        """Learn runs that are new, each given once."""
        plain = [r for r in runs if r.isalpha()] if self.marks else []
        if plain:
            self._encode_plain(plain)
        self._encode([r for r in runs if not r.isalpha()] if plain else runs, AT_ONCE)

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each with its end, and how many each text has."""
        if len(self.number) > KNOWN_WORDS or len(self.ids) > KNOWN_IDS:
            self.forget()
        at = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
        data = _LOWER[np.frombuffer(b"".join(texts), np.uint8)]
        whole = np.array([not self.by_word or MARK in t for t in texts], bool)
        for k in np.flatnonzero(whole):
            data[at[k] : at[k + 1]] = 32  # stands in the place of its runs
        runs, stops = _runs(data, at)
        told = runs.dictionary_encode()
        _, begins, body = told.dictionary.buffers()
        begins, body = np.frombuffer(begins, np.int64)[: len(told.dictionary) + 1].tolist(), body.to_pybytes() if body else b""
        distinct = [body[a:b] for a, b in itertools.pairwise(begins)]  # to_pylist() takes five times as long
        self.learn([r for r in distinct if r not in self.number])
        self._encode(list({t for t, w in zip(texts, whole, strict=True) if w}.difference(self.number)), 1)
        numbers = np.fromiter(map(self.number.__getitem__, distinct), np.int64, len(distinct))
        # Behind a text's runs stands its end, and before that a text that is tokenized as a whole.
        behind = np.cumsum(1 + whole)
        ends = np.zeros(int(behind[-1]) if len(texts) else 0, np.int64)
        ends[behind[whole] - 2] = [self.number[texts[k]] for k in np.flatnonzero(whole)]
        words = np.insert(numbers[told.indices.to_numpy()], np.repeat(stops, 1 + whole), ends)
        lengths = self.lengths[words]
        return _gathered(self.ids, self.starts[words], lengths), np.diff(np.cumsum(lengths)[stops + behind - 1], prepend=0)


@functools.lru_cache(maxsize=1)
def _known(path: str, end: int) -> WordIds:
    """What a worker knows; it serves task after task."""
    return WordIds(path, end)


def _pieces(path: str, width: int, end: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(path, end)
        for batch in batches:
            texts, keys = batch.column("text"), batch.column("doc_id")
            first = 0
            while first < len(texts):
                taken, size = [], 0
                while first + len(taken) < len(texts) and (not taken or size < CHUNK):
                    taken.append((texts[first + len(taken)].as_py() or "").encode("utf-8", "replace"))
                    size += len(taken[-1])
                ids, counts = known.of(taken)
                n_pieces = -(-counts // width)
                owner = np.repeat(np.arange(len(taken)), n_pieces)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                start, begins = piece * width, np.cumsum(counts) - counts
                length = np.minimum(counts[owner] - start, width)
                raw, at = memoryview(ids).cast("B"), (begins[owner] + start) * 4
                crc = [zlib.crc32(raw[a : a + 4 * n]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                columns = (keys.take(pa.array(owner + first)), piece.astype(np.int32), start, length, np.array(crc, np.int64))
                yield pa.record_batch([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], ["doc_id", "piece", "start", "length", "ids_crc32"])
                first += len(taken)

    return run


def pieces(docs: DataFrame, tokenizer: str, tokens: int = 2048, end: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every text, cut at ``tokens``; ``tokenizer`` is the path of its file."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_pieces(tokenizer, tokens, end), PIECE)


def pack_lengths(counts: dict[int, int], capacity: tuple[int, int, int], weights: tuple[float, float, float] = (1.0, 0.0, 0.0), rule: str = "norm") -> np.ndarray:
    """Where the pieces go, as rows (first piece, length, first sequence, pieces a sequence, offset).

    Pieces are numbered from 0 through all lengths, the longest first. A row
    holds from its first piece to that of the next row: so many after each other
    in its first sequence, from its offset on, as many in the next, and so on.
    ``capacity`` and ``weights`` are of tokens, documents, attention. Ties go to
    the sequence of the lowest number.
    """
    if rule not in ("norm", "dot"):
        raise ValueError(f"no such rule: {rule}")
    whole, weight = np.array(capacity, np.int64), np.array(weights, np.float64)
    # Classes of like sequences: what is left in each, the number of the first, how many.
    left, first, many, used, n_classes = np.zeros((64, 3), np.int64), np.zeros(64, np.int64), np.zeros(64, np.int64), np.zeros(64, np.int64), 0
    out, at, n_sequences = [], 0, 0
    for length in sorted(counts, reverse=True):
        cost, rest = np.array([length, 1, length * length], np.int64), counts[length]
        while rest:
            fits = np.flatnonzero((left[:n_classes] >= cost).all(axis=1))
            if len(fits):
                room = left[fits] / whole
                score = (weight * (room - cost / whole) ** 2).sum(axis=1) if rule == "norm" else -(weight * room * (cost / whole)).sum(axis=1)
                c = int(fits[np.lexsort((first[fits], score))[0]])
                # By the norm a sequence that was best is best again, as long as there is room; by the product its like come first.
                each = int((left[c] // cost).min()) if rule == "norm" else 1
            else:  # as many new ones as all that is left of this length takes
                each = max(1, int((whole // cost).min()))
                c, n = n_classes, -(-rest // each)
                if n_classes == len(first):
                    left, first, many, used = (np.concatenate((x, np.zeros_like(x))) for x in (left, first, many, used))
                left[c], first[c], many[c], used[c] = whole, n_sequences, n, 0
                n_sequences, n_classes = n_sequences + n, n_classes + 1
            each = min(each, rest)
            n = min(int(many[c]), rest // each)
            out.append((at, length, int(first[c]), each, int(used[c])))
            at, rest = at + n * each, rest - n * each
            if n < many[c]:  # those that got nothing are a class of their own
                if n_classes == len(first):
                    left, first, many, used = (np.concatenate((x, np.zeros_like(x))) for x in (left, first, many, used))
                left[n_classes], first[n_classes], many[n_classes], used[n_classes] = left[c], first[c] + n, many[c] - n, used[c]
                n_classes += 1
            left[c], many[c], used[c] = np.maximum(left[c] - each * cost, 0), n, used[c] + each * length
        # Sequences without room for the least piece take no part any more.
        open_ = (left[:n_classes, :2] > 0).all(axis=1)
        if not open_.all():
            n_classes = int(open_.sum())
            for x in (left, first, many, used):
                x[:n_classes] = x[: len(open_)][open_]
    return np.array(out, np.int64).reshape(-1, 5)


def _placed(spans: np.ndarray):
    """Rows with ``slot``, a piece's number among those of its length, to rows with their sequence and offset."""
    begins = {int(length): int(spans[i, 0]) for length, i in zip(*np.unique(spans[:, 1], return_index=True), strict=True)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, slot = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "slot"))
            at = slot + np.fromiter((begins[x] for x in length.tolist()), np.int64, len(length))
            row = spans[np.searchsorted(spans[:, 0], at, side="right") - 1]
            sequence, place = np.divmod(at - row[:, 0], row[:, 3])
            made = {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            yield pa.record_batch(made | {"sequence_id": pa.array(row[:, 2] + sequence), "offset": pa.array(row[:, 4] + place * length)})

    return run


def pack(
    docs: DataFrame, tokenizer: str, tokens: int = 2048, documents: int | None = None, attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.0, 0.0), rule: str = "norm", end: int = 0, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``documents`` and ``attention`` bound what a sequence holds of them; without,
    they are as much as ``tokens`` allow, so that they shut nothing out.
    """
    if tokens < 1 or (documents is not None and documents < 1):
        raise ValueError("a sequence holds at least one token and one document")
    cut = materialize(pieces(docs, tokenizer, tokens, end, key, text), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``tokens`` rows
    spans = pack_lengths(counts, (tokens, documents or tokens, attention or tokens * tokens), weights, rule)
    # Most of a large corpus may be of one length: its numbers are taken in cells.
    numbered = gapless_slots(cut, ["length"], ["doc_id", "piece", "ids_crc32"])
    return numbered.mapInArrow(_placed(spans), f"{PIECE}, sequence_id long, offset long")
