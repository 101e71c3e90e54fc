"""Packing: vector bin packing under several limits at once.

Examples are cut into pieces of at most ``max_tokens`` ids and placed by the dot-product heuristic: of
the open sequences that a piece fits under every limit (tokens, segments, loss-bearing tokens), the one
whose remaining capacity has the largest dot product with the piece's demands. A piece that fits
nowhere fills the gap of the fullest sequence and goes on in another, where cutting is allowed. What is
open at the end of a partition is laid out again and, where cutting is allowed, ends in sequences whose
lengths are powers of two, so that nothing needs padding.

How it scales. No shuffle: every partition packs its own rows, streaming, with a fixed number of open
sequences. Sequence ids carry the partition's number, so that a partition that is computed again gives
the same rows. Padding is limited to the last sequences of a partition.

Defined cases. A null text counts as empty: its one id is the end mark. Repeated rows are packed each.
An empty table gives no pieces. Columns other than the key and the text are not read.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = "doc_id long, start long, ids binary, length long, doc_tokens long, loss_tokens long, sequence_id long, offset long"


#: Words of letters that composition and lower-casing take one by one, perhaps with a full stop or comma that stands apart as a token.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,]?)")


def _byte_letters() -> dict[int, int]:
    """The letters that byte-level BPE writes for bytes: printable Latin-1 stands for itself, the others follow from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: b if b in plain else next(rest) for b in range(256)}


class WordBpe:
    """Ids of whole texts by a public byte-level BPE tokenizer whose tokens never cross white space.

    Words are encoded once while they stay in the cache, whose size is bounded. New words of plain letters
    go to the tokenizer's model, all others to the whole tokenizer, with a mark between them.
    """

    MARK = "\x01"

    def __init__(self, path: str, cache: int = 600_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.of = Tokenizer.from_file(path)
        self.model, self.letters = self.of.model, _byte_letters()
        self.cache, self.known = cache, {}
        (self.mark,) = self.of.encode(self.MARK, add_special_tokens=False).ids

    def _letters(self, word: str) -> bytes:
        got = self.known.get(word)
        if got is None:
            form = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            got = self.known[word] = array("I", [t.id for t in self.model.tokenize(form)]).tobytes()
        return got

    def _learn(self, words: set[str]) -> None:
        rest = []
        for w in words:
            if m := _PLAIN.fullmatch(w):
                got = self._letters(m[1].lower())
                self.known[w] = got + self._rest([m[2]])[0] if m[2] else got
            else:
                rest.append(w)
        self.known.update(zip(rest, self._rest(rest), strict=True))

    def _rest(self, words: list[str]) -> list[bytes]:
        if len(words) == 1 and words[0] in self.known:
            return [self.known[words[0]]]
        out: dict[str, bytes] = {}
        plain = [w for w in words if self.MARK not in w]
        parts = [plain[k : k + 200] for k in range(0, len(plain), 200)]
        for part, got in zip(parts, self.of.encode_batch_fast([f" {self.MARK} ".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, np.uint32)
            raw, at = ids.tobytes(), 0
            for w, e in zip(part, [*np.flatnonzero(ids == self.mark).tolist(), len(ids)], strict=True):
                out[w] = raw[4 * at : 4 * e]
                at = e + 1
        for w in words:
            if w not in out:
                out[w] = np.array(self.of.encode(w, add_special_tokens=False).ids, np.uint32).tobytes()
        if len(words) == 1:
            self.known.update(out)
        return [out[w] for w in words]

    def rest(self, most: int = 100_000) -> None:
        """At a task's end: don't hold memory that the process's next task may need for something else."""
        if len(self.known) > most:
            self.known.clear()

    def _whole(self, text: str) -> bool:
        """Whether words can't be taken one by one: special tokens, which stand for themselves, and marks at which Python splits and the tokenizer doesn't."""
        return "<|" in text or any(c in text for c in "\x1c\x1d\x1e\x1f")

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        split = [None if self._whole(t) else t.split() for t in texts]
        if len(self.known) > self.cache:
            self.known.clear()
        self._learn({w for words in split if words for w in words}.difference(self.known))
        get = self.known.__getitem__
        for text, words in zip(texts, split, strict=True):
            if words is None:
                yield np.array(self.of.encode(text, add_special_tokens=False).ids, np.uint32)
            else:
                yield np.frombuffer(b"".join(map(get, words)), np.uint32)


_ENCODERS: dict[str, WordBpe] = {}


def encoder_of(path: str) -> WordBpe:
    """One encoder for each process: Python workers are used again for other tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordBpe(path)
    return _ENCODERS[path]


class Packer:
    """Packs a stream of (key, ids, loss or None); emits (key, start, ids, doc_tokens, loss tokens, sequence, offset)."""

    def __init__(self, first_id: int, max_tokens: int = 4096, max_segments: int = 512, max_loss: int | None = None, cut: bool = True, most_open: int = 64) -> None:
        self.limits = np.array([max_tokens, max_segments, max_loss or max_tokens], float)
        self.max_tokens, self.cut, self.most_open, self.next_id = max_tokens, cut, most_open, first_id
        self.left = np.zeros((0, 3))
        self.bins: list[list[tuple]] = []

    def _emit(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for key, start, ids, loss, total in pieces:
            yield key, start, ids, total, int(loss.sum()) if loss is not None else len(ids), self.next_id, offset
            offset += len(ids)
        self.next_id += 1

    def _close(self, k: int) -> Iterator[tuple]:
        pieces = self.bins.pop(k)
        self.left = np.delete(self.left, k, 0)
        yield from self._emit(pieces)

    def _put(self, k: int, piece: tuple, need: np.ndarray) -> Iterator[tuple]:
        self.bins[k].append(piece)
        self.left[k] -= need
        if (self.left[k][:2] <= 0).any() or self.left[k][2] <= 0:
            yield from self._close(k)

    def add(self, key, ids: np.ndarray, loss: np.ndarray | None = None) -> Iterator[tuple]:
        total, start = len(ids), 0
        if total > self.max_tokens and not self.cut:
            raise ValueError(f"an example of {total} tokens can't be packed whole into {self.max_tokens}")
        while start < total:
            end = min(total, start + self.max_tokens)
            if loss is not None and self.cut:  # a piece keeps to the limit on loss-bearing tokens
                end = min(end, start + max(1, int(np.searchsorted(np.cumsum(loss[start:end]), self.limits[2], side="right"))))
            yield from self._place(key, start, ids[start:end], None if loss is None else loss[start:end], total)
            start = end

    def _need(self, ids, loss) -> np.ndarray:
        return np.array([len(ids), 1, len(ids) if loss is None else float(loss.sum())], float)

    def _place(self, key, start: int, ids: np.ndarray, loss, total: int) -> Iterator[tuple]:
        while len(ids):
            need = self._need(ids, loss)
            if (need > self.limits).any():
                raise ValueError("an example is beyond the limits of a sequence")
            fits = (self.left >= need).all(1)
            if fits.any():
                score = np.where(fits, (self.left / self.limits) @ (need / self.limits), -1.0)
                # a piece that fills a sequence to the last token goes there
                score = np.where(fits & (self.left[:, 0] == need[0]), np.inf, score)
                yield from self._put(int(score.argmax()), (key, start, ids, loss, total), need)
                return
            if len(self.bins) < self.most_open:
                self.bins.append([])
                self.left = np.vstack([self.left, self.limits])
                yield from self._put(len(self.bins) - 1, (key, start, ids, loss, total), need)
                return
            k = int(self.left[:, 0].argmin())
            if not self.cut:
                yield from self._close(k)
                continue
            size = int(min(self.left[k][0], len(ids)))
            if loss is not None:
                size = min(size, int(np.searchsorted(np.cumsum(loss), self.left[k][2], side="right")))
            if size <= 0:
                yield from self._close(k)
                continue
            head = ids[:size], None if loss is None else loss[:size]
            yield from self._put(k, (key, start, *head, total), self._need(*head))
            ids, loss, start = ids[size:], None if loss is None else loss[size:], start + size

    def end(self) -> Iterator[tuple]:
        if not self.cut:
            while self.bins:
                yield from self._close(0)
            return
        rest = [p for b in sorted(self.bins, key=len) for p in b]
        self.bins, self.left = [], np.zeros((0, 3))
        tokens = sum(len(p[2]) for p in rest)
        room, now, used = 0, [], np.zeros(3)
        while rest:
            if not room:
                room = self.max_tokens if tokens >= self.max_tokens else 1 << (tokens.bit_length() - 1)
            key, start, ids, loss, total = rest.pop(0)
            size = min(room, len(ids))
            if loss is not None:
                size = min(size, max(0, int(np.searchsorted(np.cumsum(loss), self.limits[2] - used[2], side="right"))))
            if size == 0 or used[1] + 1 > self.limits[1]:
                yield from self._emit(now)
                rest.insert(0, (key, start, ids, loss, total))
                room, now, used = 0, [], np.zeros(3)
                continue
            head = ids[:size], None if loss is None else loss[:size]
            now.append((key, start, *head, total))
            used += self._need(*head)
            room, tokens = room - size, tokens - size
            if size < len(ids):
                rest.insert(0, (key, start + size, ids[size:], None if loss is None else loss[size:], total))
            if not room:
                yield from self._emit(now)
                now, used = [], np.zeros(3)
        if now:
            yield from self._emit(now)


def pack_texts(docs: DataFrame, tokenizer: str, end_id: int = 2, text: str = "text", key: str = "doc_id", loss_mask: Callable | None = None, **limits) -> DataFrame:
    """Tokenize whole texts, end each with ``end_id``, and pack them; one row per piece, its ids as little-endian unsigned 32-bit integers.

    ``loss_mask`` maps ids to booleans, true where the loss counts; by default it counts everywhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        packer = Packer(TaskContext.get().partitionId() << 32, **limits)
        names = [x.split()[0] for x in PIECES.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 5]

        def rows(got: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*((k, s, i.astype("<u4").tobytes(), len(i), t, m, q, o) for k, s, i, t, m, q, o in got), strict=True)) or [[]] * 8
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        tail = np.array([end_id], np.uint32)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                out: list[tuple] = []
                texts = [t or "" for t in part.column(1).to_pylist()]
                for k, ids in zip(part.column(0).to_pylist(), encoder.encode(texts), strict=True):
                    ids = np.concatenate([ids, tail])
                    out += packer.add(k, ids, None if loss_mask is None else np.asarray(loss_mask(ids), bool))
                yield rows(out)
        encoder.rest()
        yield rows(list(packer.end()))

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, PIECES)


def op7_packing(spark, sf_dir):
    import public_tokenizers

    from .common import table

    packed = pack_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
