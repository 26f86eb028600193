"""SentencePiece encoding and decoding by a table of distinct marked words.

The library writes a blank as a mark, puts one before the text, and joins characters to pieces. Where no piece of the
vocabulary holds a mark behind another sign, no piece can cross from the end of a word to the mark of the next, so a marked word
(a run of marks with what follows up to the next mark) has the same pieces wherever it stands. A table of the distinct
marked words of the texts at hand holds the ids of each, segmented once by the library; the ids of a text are those of its
words, joined by position. New words go to the library as one text, and its ids are cut before the pieces that begin with a mark.
Decoding joins the bytes of the pieces by position.

The vocabulary is tested for that property when it is loaded, and that it neither normalises texts nor drops blanks; with any other
model, and for ids that are unknown or no valid text, each whole text goes to the library, so results are the library's with every model.

Texts stay where they are: a table belongs to a task and holds at most about MOST characters, then starts anew. One table for all
tasks would shuffle a row for each word and block of texts and move every text once more, to save segmenting words again that
take microseconds.

Null texts count as empty, and an empty text has no ids but the begin and the end. Repeated rows are encoded one by
one; an empty table gives an empty result. All columns stay, whatever their names, and the new ones come last; ids are binary, little-endian
unsigned 32-bit numbers. Null ids decode to an empty text. A text of any length is one row, as in the table it comes from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

MARK = "▁"
#: Characters of the words that a task remembers before it starts anew.
MOST = 8 << 20
#: Bytes of texts or ids that a task has as Python objects at one time, but for a longer one alone.
SLICE = 2 << 20
#: Words that go to the library as one text.
TOGETHER = 4096
WORD = re.compile(r" *[^ ]+| +")
_MODELS: dict[str, Model] = {}


class Model:
    """A model with its table of distinct words, keyed without their first mark and with other marks as blanks."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lib.get_piece_size()
        kept = [not (lib.is_control(i) or lib.is_byte(i) or lib.is_unknown(i)) for i in range(size)]
        pieces = [lib.id_to_piece(i) for i in range(size)]
        self.begin, self.end = lib.bos_id(), lib.eos_id()
        test = "  a  ﬁ Ａ b "  # blanks and letters that other models change
        same = lib.normalize(test) == MARK + test.replace(" ", MARK)
        self.apart = same and lib.piece_to_id(MARK) != lib.unk_id() and all(MARK not in p.lstrip(MARK) for p, k in zip(pieces, kept) if k)
        self.marked = np.array([k and p.startswith(MARK) for p, k in zip(pieces, kept)])
        self.odd = np.array([not (k or lib.is_byte(i) or lib.is_control(i)) for i, k in enumerate(kept)])
        raw = [p.replace(MARK, " ").encode() if k else bytes([int(p[3:5], 16)]) if lib.is_byte(i) else b"" for i, (p, k) in enumerate(zip(pieces, kept))]
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.size = np.array([len(r) for r in raw], np.int32)
        self.start = np.cumsum(self.size, dtype=np.int32) - self.size
        self.ids: dict[str, bytes] = {}
        self.held = 0

    def _cut(self, text: str) -> list[str]:
        """The words of a text, each without its first mark."""
        if not text or not self.apart:
            return [text] if text else []
        text = text.replace(MARK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [w[1:] for w in WORD.findall(" " + text)]
        return text.split(" ")

    def _segment(self, words: list[str]) -> list[bytes]:
        """The ids of each of the words."""
        if not self.apart:
            return [np.array(i, "<u4").tobytes() for i in self.library.encode(words, num_threads=1)]
        out: dict[str, bytes] = {"": np.array([self.library.piece_to_id(MARK)], "<u4").tobytes()}
        simple = [w for w in words if w and " " not in w]  # these have one mark, so one piece that begins with it
        for lo in range(0, len(simple), TOGETHER):
            some = simple[lo : lo + TOGETHER]
            ids = np.array(self.library.encode(" ".join(some)), "<u4")
            at = np.flatnonzero(self.marked[ids]) * 4
            raw, ends = ids.tobytes(), [*at[1:].tolist(), 4 * len(ids)]
            out.update(zip(some, [raw[a:b] for a, b in zip(at.tolist(), ends)], strict=True))
        rest = [w for w in words if " " in w]
        out.update(zip(rest, (np.array(i, "<u4").tobytes() for i in self.library.encode(rest, num_threads=1)) if rest else ()))
        return [out[w] for w in words]

    def encode(self, batch: list[str | None]) -> list[bytes]:
        """The ids of each text, with begin and end."""
        cut = [self._cut(t or "") for t in batch]
        distinct = set().union(*cut)
        new = [*distinct.difference(self.ids)]
        if self.held + sum(map(len, new)) > MOST:
            self.ids.clear()
            self.held, new = 0, [*distinct]
        self.held += sum(map(len, new))
        self.ids.update(zip(new, self._segment(new)))
        first, last = (np.array([i] if i >= 0 else [], "<u4").tobytes() for i in (self.begin, self.end))
        of = self.ids.__getitem__
        return [b"".join([first, *map(of, c), last]) for c in cut]

    def decode(self, batch: list[bytes | None]) -> list[str]:
        """The text of each list of ids."""
        rows = [np.frombuffer(b or b"", "<u4") for b in batch]
        if not self.apart:
            return [self.library.decode(r.tolist()) for r in rows]
        ids = np.concatenate([*rows, np.zeros(0, "<u4")])
        size = self.size[ids]
        ends = np.cumsum(size, dtype=np.int64)
        places = np.arange(ends[-1] if len(ends) else 0, dtype=np.int32) + np.repeat((self.start[ids] - ends + size).astype(np.int32), size)
        raw = self.bytes[places].tobytes()
        edges = np.concatenate([[0], ends])[np.cumsum([0, *map(len, rows)])].tolist()
        return [self._text(r, raw[a:b]) for r, a, b in zip(rows, edges, edges[1:])]

    def _text(self, ids: np.ndarray, raw: bytes) -> str:
        """What the library makes of ids whose pieces' bytes are ``raw``: without the mark that it had put before the text."""
        if not len(raw):
            return ""
        if not self.odd[ids].any():
            try:
                return raw[bool(self.marked[ids[self.size[ids] > 0][0]]) :].decode()
            except UnicodeDecodeError:
                pass
        return self.library.decode(ids.tolist())


def model(path: str | None) -> Model:
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    if path not in _MODELS:
        _MODELS.clear()
        _MODELS[path] = Model(path)
    return _MODELS[path]


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose values in ``column`` have about SLICE bytes (a longer value goes alone)."""
    values = batch.column(column)
    sizes = np.nan_to_num(pc.binary_length(values).to_numpy(zero_copy_only=False).astype(float)) if batch.num_rows else np.zeros(0)
    part = (np.cumsum(sizes) // SLICE).astype(np.int64)
    starts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(starts, starts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _added(rows: DataFrame, column: str, path: str | None, fields: list[T.StructField], make) -> DataFrame:
    at, names = rows.columns.index(column), [*rows.columns, *(f.name for f in fields)]
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for whole in batches:
            for batch in _slices(whole, at):
                made = make(m, batch.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, k) for x, k in zip(made, kinds))], names=names)

    return rows.toDF(*[f"c{i}" for i in range(len(rows.columns))]).mapInArrow(run, T.StructType([*rows.schema.fields, *fields]))


IDS, DECODED = T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())


def encode(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``ids``, those of its text with begin and end."""
    return _added(docs, text, path, [IDS], lambda m, batch: [m.encode(batch)])


def decode(rows: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``, the text of its ids."""
    return _added(rows, ids, path, [DECODED], lambda m, batch: [m.decode(batch)])


def round_trip(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` and, read back from these, ``decoded``, in one pass."""

    def make(m: Model, batch: list[str | None]) -> list:
        ids = m.encode(batch)
        return [ids, m.decode(ids)]

    return _added(docs, text, path, [IDS, DECODED], make)
