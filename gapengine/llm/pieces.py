"""SentencePiece encoding and decoding with a batched Viterbi search.

A text is a space in front, spaces turned into the mark U+2581, and then words,
each from its marks to the next mark.  As no piece holds a mark behind another
character, the best segmentation of the text is that of its words.  The
different words of a batch are grouped by length, and all of one length advance
together: hashes of their substrings are looked up in the sorted hashes of the
pieces of each length, and at every position one maximum over the piece lengths
sets all back pointers.  Characters that no piece covers become byte pieces, so
decoding gives back the exact text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gapengine.llm.wordhash import CHUNK_BYTES, _Powers, buffers, chunks, mix

U = np.uint64
MARK = 0x2581
# A mark that is part of the text: no code point, so no piece has it.
LITERAL_MARK = 0x110000
CELLS = 1 << 16
# Words a task keeps with their pieces: some tens of megabytes.
REMEMBERED = 400_000
UNKNOWN_PENALTY = 10.0
UNKNOWN_TEXT = " ⁇ "


class Pieces:
    """A vocabulary: pieces, their scores, and which are byte, unknown or control pieces."""

    def __init__(self, pieces: Sequence[str], scores: Sequence[float], kinds: Sequence[str]):
        normal = [i for i, k in enumerate(kinds) if k == "normal"]
        if any(chr(MARK) in pieces[i].lstrip(chr(MARK)) for i in normal):
            raise ValueError("a piece holds a word mark behind another character")
        self.unknown = next(i for i, k in enumerate(kinds) if k == "unknown")
        self.bytes = np.full(256, self.unknown, dtype=np.int32)
        for i, k in enumerate(kinds):
            if k == "byte":
                self.bytes[int(pieces[i][3:5], 16)] = i
        self.unknown_score = min(scores[i] for i in normal) - UNKNOWN_PENALTY
        self.memory = (np.zeros(0, U), np.zeros(0, np.int32), np.zeros(0, np.int64))
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in sorted({len(pieces[i]) for i in normal}):
            ids = np.array([i for i in normal if len(pieces[i]) == length], dtype=np.int32)
            points = np.array([[ord(c) for c in pieces[i]] for i in ids], dtype=np.uint64)
            keys = _windows(_sums(points), length)[:, 0]
            order = np.argsort(keys)
            self.by_length[length] = keys[order], ids[order], np.array([scores[i] for i in ids])[order]
        self.raw = [
            bytes([int(p[3:5], 16)]) if k == "byte" else UNKNOWN_TEXT.encode() if k == "unknown" else b"" if k == "control"
            else p.replace(chr(MARK), " ").encode() for p, k in zip(pieces, kinds, strict=True)
        ]

    @classmethod
    def load(cls, path: str) -> Pieces:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = range(model.get_piece_size())
        kinds = ["unknown" if model.is_unknown(i) else "control" if model.is_control(i) else "byte" if model.is_byte(i) else "normal" for i in n]
        return cls([model.id_to_piece(i) for i in n], [model.get_score(i) for i in n], kinds)

    def words(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best pieces of each row of ``points`` (words of one length): ids from the end backwards, piece lengths, counts."""
        n, length = points.shape
        widths = [w for w in sorted(self.by_length, reverse=True) if w <= length]
        if 1 not in widths:
            widths.append(1)
        sums = _sums(points)
        score = np.full((len(widths), n, length), -np.inf)
        piece = np.zeros((len(widths), n, length), dtype=np.int32)
        for k, w in enumerate(widths):
            if w == 1:
                score[k], piece[k] = self.unknown_score, self.unknown
            if w in self.by_length:
                keys, ids, values = self.by_length[w]
                probe = _windows(sums, w)
                at = np.minimum(np.searchsorted(keys, probe), len(keys) - 1)
                hit = keys[at] == probe
                # Indexed by the position of the piece's last character.
                score[k, :, w - 1 :][hit] = values[at[hit]]
                piece[k, :, w - 1 :][hit] = ids[at[hit]]
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((n, length + 1), dtype=np.int64)
        starts = np.array(widths)
        for end in range(1, length + 1):
            fits = starts <= end
            value = best[:, end - starts[fits]].T + score[fits, :, end - 1]
            # The longest piece comes first and wins ties.
            choice = value.argmax(axis=0)
            best[:, end] = value[choice, np.arange(n)]
            back[:, end] = np.flatnonzero(fits)[choice]
        at, rows = np.full(n, length), np.arange(n)
        out, spans, count = np.full((n, length), -1, dtype=np.int32), np.zeros((n, length), dtype=np.int64), np.zeros(n, dtype=np.int64)
        for step in range(length):
            live = at > 0
            if not live.any():
                break
            r, e = rows[live], at[live]
            k = back[r, e]
            out[r, step], spans[r, step] = piece[k, r, e - 1], starts[k]
            at[live] = e - starts[k]
            count[live] += 1
        return out, spans, count

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of UTF-8 texts, end to end, and how many each has."""
        texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], dtype=np.int64)
        points = np.frombuffer("".join(f"\0{t}" for t in texts if t).encode("utf-32-le"), np.uint32).astype(np.int64)
        points[points == MARK] = LITERAL_MARK
        points[points == 0x20] = MARK
        heads = (np.cumsum(sizes) - sizes)[sizes > 0]
        points[heads] = MARK
        mark = points == MARK
        first = mark.copy()
        first[1:] &= ~mark[:-1]
        first[heads] = True
        starts = np.flatnonzero(first)
        lengths = np.diff(np.append(starts, len(points)))
        up, down = _Powers.upto(len(points) + 1)
        total = np.zeros(len(points) + 1, dtype=U)
        np.cumsum(mix(points.astype(U) + U(1)) * up[:-1], out=total[1:])
        names = mix((total[starts + lengths] - total[starts]) * down[starts]) + lengths.astype(U)
        names, sample, which = np.unique(names, return_index=True, return_inverse=True)
        ids, counts = self._remembered(names, points, starts[sample], lengths[sample])
        ids, taken = _gathered(ids, np.cumsum(counts) - counts, counts, which)
        text_of_word = np.searchsorted(heads, starts, side="right") - 1
        per_text = np.zeros(len(texts), dtype=np.int64)
        per_text[sizes > 0] = np.bincount(text_of_word, weights=taken, minlength=len(heads)).astype(np.int64) if len(heads) else 0
        return ids, per_text

    def _remembered(self, names: np.ndarray, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of different words (sorted by name); those of earlier batches are kept, up to ``REMEMBERED`` words."""
        known, old_ids, old_counts = self.memory
        at = np.minimum(np.searchsorted(known, names), max(0, len(known) - 1))
        hit = known[at] == names if len(known) else np.zeros(len(names), dtype=bool)
        new = np.flatnonzero(~hit)
        new_ids, new_counts = self._different_words(points, starts[new], lengths[new])
        all_ids, all_counts = np.concatenate([old_ids, new_ids]), np.concatenate([old_counts, new_counts])
        begins = np.cumsum(all_counts) - all_counts
        where = at.copy()
        where[new] = len(known) + np.arange(len(new))
        ids, counts = _gathered(all_ids, begins, all_counts, where)
        if len(known) + len(new) <= REMEMBERED:
            every = np.concatenate([known, names[new]])
            order = np.argsort(every)
            self.memory = (every[order], *_gathered(all_ids, begins, all_counts, order))
        return ids, counts

    def _different_words(self, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        order = np.argsort(lengths, kind="stable")
        bounds = np.flatnonzero(np.diff(lengths[order], prepend=-1, append=-1)) if len(order) else np.zeros(0, int)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            length = int(lengths[order[a]])
            step = max(1, CELLS // length)
            for s in range(a, b, step):
                rows = order[s : min(s + step, b)]
                chars = points[starts[rows][:, None] + np.arange(length)]
                ids, spans, count = self.words(chars)
                take = count[:, None] - 1 - np.arange(int(count.max()))
                real = take >= 0
                take = np.maximum(take, 0)
                ids, spans = np.take_along_axis(ids, take, axis=1), np.take_along_axis(spans, take, axis=1)
                if (ids[real] == self.unknown).any():
                    place = np.cumsum(spans * real, axis=1) - spans
                    for i, row in enumerate(rows.tolist()):
                        line = ids[i][real[i]]
                        if (line == self.unknown).any():
                            line = np.concatenate([
                                self._as_bytes(int(chars[i, p])) if x == self.unknown else np.array([x], dtype=np.int32)
                                for x, p in zip(line, place[i][real[i]], strict=True)
                            ])
                        found.append((np.full(len(line), row), line))
                else:
                    found.append((np.repeat(rows, count), ids[real]))
        if not found:
            return np.zeros(0, np.int32), np.zeros(len(lengths), np.int64)
        word = np.concatenate([w for w, _ in found])
        ids = np.concatenate([x for _, x in found])
        return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(lengths))

    def _as_bytes(self, point: int) -> np.ndarray:
        return self.bytes[list(chr(MARK if point == LITERAL_MARK else point).encode("utf-8", "surrogatepass"))]

    def decode(self, ids: Sequence[int]) -> str:
        """The text of piece ids; unknown ids read as the unknown piece, broken bytes as U+FFFD."""
        raw = self.raw
        n = len(raw)
        whole = b"".join([raw[i] if i is not None and 0 <= i < n else raw[self.unknown] for i in ids])
        return (whole[1:] if whole[:1] == b" " else whole).decode("utf-8", "replace")


def _gathered(ids: np.ndarray, begins: np.ndarray, counts: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    taken = counts[where]
    return ids[np.repeat(begins[where] - (np.cumsum(taken) - taken), taken) + np.arange(int(taken.sum()))], taken


def _sums(points: np.ndarray) -> np.ndarray:
    """Running polynomial hash of each row, from which those of its substrings follow."""
    n, length = points.shape
    up, _ = _Powers.upto(length + 1)
    total = np.zeros((n, length + 1), dtype=U)
    np.cumsum(mix(points.astype(U) + U(1)) * up[:length], axis=1, out=total[:, 1:])
    return total


def _windows(total: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all substrings of ``width`` characters of each row."""
    count = total.shape[1] - width
    _, down = _Powers.upto(total.shape[1])
    return mix((total[:, width:] - total[:, :count]) * down[:count])


def _encoded(shared, text: int, keep: Sequence[int], decode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: Pieces = shared.value
        for batch in batches:
            column = batch.column(text)
            data, offsets = buffers(column)
            for a, b in chunks(offsets, CHUNK_BYTES // 8):
                ids, counts = pieces.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ends = np.zeros(b - a + 1, dtype=np.int32)
                np.cumsum(counts, out=ends[1:])
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32()))
                missing = column.slice(a, b - a).is_null()
                out = [batch.column(i).slice(a, b - a) for i in keep]
                names = [batch.schema.names[i] for i in keep]
                if decode:
                    rows = ids.tolist()
                    texts = [pieces.decode(rows[s:e]) for s, e in zip(ends[:-1], ends[1:], strict=True)]
                    out.append(pa.array(texts, mask=np.asarray(missing)))
                    names.append("decoded")
                if column.null_count:
                    lists = pa.array([None if m else x for m, x in zip(missing.to_pylist(), lists.to_pylist(), strict=True)], pa.list_(pa.int32()))
                yield pa.record_batch([*out, lists], names=[*names, "ids"])

    return run


def encode_pieces(docs: DataFrame, model: str, text_col: str = "text", decode: bool = False) -> DataFrame:
    """``docs`` with ``ids``, the piece ids of each whole text, and with ``decode`` the text they decode to as ``decoded``.

    ``model`` is the path of a vocabulary file on the driver; the vocabulary,
    whose size doesn't depend on the data, is broadcast.  The ids maximise the
    sum of the file's scores, of equal sums the one with the longest last
    piece, and so on backwards.  A null text has null ids, an empty one none.
    Rows and other columns stay as they are; columns named ``ids`` or
    ``decoded`` are replaced.
    """
    docs = docs.drop("ids", "decoded")
    shared = docs.sparkSession.sparkContext.broadcast(Pieces.load(model))
    from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

    fields = StructType(list(docs.schema.fields))
    fields = fields.add("decoded", StringType()) if decode else fields
    keep = range(len(docs.columns))
    return docs.mapInArrow(_encoded(shared, docs.columns.index(text_col), keep, decode), fields.add("ids", ArrayType(IntegerType())))


def decode_pieces(rows: DataFrame, model: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """``rows`` with ``out``, the text of the piece ids; null for null ids."""
    from pyspark.sql.types import StringType, StructType

    rows = rows.drop(out)
    shared = rows.sparkSession.sparkContext.broadcast(Pieces.load(model))
    place = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else shared.value.decode(x) for x in batch.column(place).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return rows.mapInArrow(run, StructType(list(rows.schema.fields)).add(out, StringType()))
