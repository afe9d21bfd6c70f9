"""Token ids in files of independent zstandard frames with a seek table.

A file holds consecutive documents in ascending id order:

    data frames       little-endian unsigned 32-bit ids, whole documents each
    skippable frame   zstandard-compressed document index (see ``_INDEX``)
    skippable frame   seek table: per data frame its compressed and content
                      size and the low 32 bits of the content's xxhash64,
                      then the footer of zstandard's seekable format

so any zstandard reader decompresses a file, and :func:`read_documents`
decompresses only the frames that hold the documents it was asked for.

Documents are dealt to files by ranges of their id.  Each task writes a file
under a name of its own attempt and moves it to its final place when it is
complete, so a task that is run again leaves the same file.

Defined results: null and empty texts have the end id alone; null ids come
first; repeated rows are written as often as they come; an empty table writes
no file.
"""

from __future__ import annotations

import gc
import os
import posixpath
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, compress, repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import prepare, shared_folder, stage, texts

# Fixed values of the seekable format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
_FOOTER = struct.Struct("<IBI")
_ENTRY = struct.Struct("<III")
_INDEX = np.dtype([("doc_id", "<i8"), ("null_id", "u1"), ("frame", "<u4"), ("offset", "<u8"), ("n_tokens", "<u8")])

#: Least content bytes of a frame before the next document opens another.
FRAME_BYTES = 256 * 1024
END_ID = 0

#: White space after a space, wherever any version of Unicode sees some.
_SPACE_RUN = r" [\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"

# What the splitting pattern of such models tells apart, for characters
# whose class every version of Unicode agrees on (no apostrophes, which begin
# contractions).  Classes of bytes: the letters beyond ASCII are two bytes long and
# begin with C3 to C9; _classes takes out those that are no letters.
_L = "A-Za-zÀ-ÖØ-öø-ɏ"
_PLAIN = re.compile(rf"[ \n!-&(-~{_L}]+")
_ODD, _SPACE, _LINE, _DIGIT, _LETTER, _MARK = range(6)


def _class(byte: int) -> int:
    char = chr(byte)
    if 0x80 <= byte < 0xC0 or 0xC3 <= byte <= 0xC9 or char.isascii() and char.isalpha():
        return _LETTER
    if char in " \n":
        return _SPACE if char == " " else _LINE
    if char.isascii() and char.isdigit():
        return _DIGIT
    return _MARK if "!" <= char <= "~" and char != "'" else _ODD


_CLASSES = bytes(map(_class, range(256)))

#: Bytes of text that are cut at once; the arrays of a cut take many times as much.
PORTION_BYTES = 1 << 20

#: Between units that are spelled together; no plain character.
_BETWEEN = "\t"


# --- encoding --------------------------------------------------------------

class Table:
    """Names, each with its ids, all in one array; a name's place is its number."""

    def __init__(self):
        self.known: dict[str | None, int] = {}
        self.ids = np.zeros(1 << 16, "<u4")
        self.starts, self.lengths = np.zeros(1 << 14, "i8"), np.zeros(1 << 14, "i8")
        self.again = np.zeros(1 << 14, bool)  # found when looked up, not learnt then
        self.used = 0

    def add(self, names: list, lengths: np.ndarray, ids: np.ndarray) -> None:
        total, at = len(ids), len(self.known)
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while at + len(names) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
            self.again = np.concatenate([self.again, np.zeros_like(self.again)])
        self.ids[self.used : self.used + total] = ids
        self.starts[at : at + len(names)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[at : at + len(names)] = lengths
        self.used += total
        self.known.update(zip(names, range(at, at + len(names))))

    def places(self, names: list[str], learn: Callable[[list[str]], None]) -> np.ndarray:
        """Places of the names; those not known are learnt first."""
        at = np.fromiter(map(self.known.get, names, repeat(-1)), "i8", len(names))
        self.again[at[at >= 0]] = True
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = [names[i] for i in missing.tolist()]
            learn(list(dict.fromkeys(new)))
            at[missing] = np.fromiter(map(self.known.__getitem__, new), "i8", len(new))
        return at

    def met_again(self) -> Table:
        """A table of the names that were found when looked up; places are new."""
        kept, found = Table(), self.again[: len(self.known)]
        at = np.flatnonzero(found)
        kept.add(list(compress(self.known, found.tolist())), self.lengths[at], self.joined(at)[0])
        return kept

    def joined(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the names at these places one after the other, and where each name's end."""
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        return self.ids[np.repeat(self.starts[at] - (ends - lengths), lengths) + np.arange(lengths.sum())], ends


def _classes(data: bytes) -> np.ndarray:
    """The class of each byte of valid UTF-8."""
    found = np.frombuffer(data.translate(_CLASSES), "u1")
    if not data.isascii():
        found, byte = found.copy(), np.frombuffer(data, "u1")
        before, after = byte[:-1], byte[1:]
        # the signs of multiplication and division; letters after U+024F
        found[1:][(before == 0xC3) & ((after == 0x97) | (after == 0xB7)) | (before == 0xC9) & (after >= 0x90)] = _ODD
    return found


def _cuts(data: bytes) -> np.ndarray:
    """Where the units of a text begin.  It must begin with a space, as each
    space begins a unit.  What stands from one space to the next is left whole
    unless all of it is plain; then it is cut by the model's own pattern."""
    kind = _classes(data)
    space, line = kind == _SPACE, kind == _LINE
    begins = space.copy()
    begins[1:] |= (kind[1:] != kind[:-1]) & (~space[:-1] | line[1:])
    # the last of many line ends stands alone if a character follows
    begins[1:-1] |= line[:-2] & line[1:-1] & ~line[2:] & ~space[2:]
    cuts = np.flatnonzero(begins)
    odd = np.flatnonzero(kind == _ODD)
    if len(odd):
        opens = space[cuts]
        whole = np.zeros(int(opens.sum()), bool)
        whole[np.searchsorted(cuts[opens], odd, "right") - 1] = True
        cuts = cuts[opens | ~whole[np.cumsum(opens) - 1]]
    return cuts


class Encoder:
    """Whole texts to ids with a byte-level ``tokenizers`` model.

    Such a model never joins what stands before a space with the space and the
    mark after it, nor pieces that its splitting pattern tells apart.  So a text's
    ids are those of its units (see :func:`_cuts`) one after the other.  The texts
    of a portion are cut together, and each distinct unit is looked up once.  A
    new unit of plain characters goes to the model's merges in its spelling of
    bytes; other units go through the whole model.  Units repeat: their ids stay
    in a table.  Beyond ``keep`` units or eight times as many ids it drops those not
    met again since it last did, and starts anew if over half of either is left."""

    def __init__(self, path: str, end_id: int = END_ID, keep: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model, self.end_id, self.keep = Tokenizer.from_file(path), end_id, keep
        self.spelling = {b: c for b, c in byte_spelling().items() if b != ord(_BETWEEN)}
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.units = self._new_units()

    def _new_units(self) -> Table:
        units = Table()
        units.add([None], np.ones(1, "i8"), np.array([self.end_id]))
        return units

    def _make_room(self) -> None:
        units, keep = self.units, self.keep
        if len(units.known) > keep or units.used > keep * 8:
            units.again[units.known[None]] = True
            fit = np.count_nonzero(units.again) <= keep // 2 and units.lengths[units.again].sum() <= keep * 4
            self.units = units.met_again() if fit else self._new_units()

    def _learn(self, units: list[str]) -> None:
        plain = list(map(_PLAIN.fullmatch, units))
        rest = [u for u, p in zip(units, plain) if p is None]
        units = [u for u, p in zip(units, plain) if p is not None]
        if units:
            merge, ids, lengths = self.model.model.tokenize, [], []
            for spelled in _BETWEEN.join(units).encode().decode("latin-1").translate(self.spelling).split(_BETWEEN):
                found = merge(spelled)
                lengths.append(len(found))
                ids += [t.id for t in found]
            self.units.add(units, np.array(lengths, "i8"), np.array(ids, "<u4"))
        if rest:
            found = [e.ids for e in self.model.encode_batch_fast(rest, add_special_tokens=False)]
            self.units.add(rest, np.fromiter(map(len, found), "i8", len(found)), np.fromiter(chain.from_iterable(found), "<u4"))

    def encode(self, lines) -> list[np.ndarray]:
        """The ids of each text of an Arrow array (null: empty), the end id last."""
        lines = pc.fill_null(lines if isinstance(lines, (pa.Array, pa.ChunkedArray)) else pa.array(lines, pa.string()), "")
        if not len(lines):
            return []
        # a space before white space stays with what stands before it, and a
        # special token may hold a space: such texts go through the whole model
        odd = pc.match_substring_regex(lines, _SPACE_RUN)
        for special in self.special:
            odd = pc.or_(odd, pc.match_substring(lines, special))
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        even = np.flatnonzero(~odd.to_numpy(zero_copy_only=False))
        out: list = [None] * len(lines)
        end = np.array([self.end_id], "<u4")
        found = self.model.encode_batch_fast(lines.take(pa.array(whole)).to_pylist(), add_special_tokens=False)
        for i, e in zip(whole.tolist(), found):
            out[i] = np.concatenate([np.array(e.ids, "<u4"), end])
        if len(even):
            lines = lines.take(pa.array(even)).cast(pa.binary())
            lines = lines.combine_chunks() if isinstance(lines, pa.ChunkedArray) else lines
            portion = np.cumsum(pc.binary_length(lines).to_numpy(zero_copy_only=False).astype("i8")) // PORTION_BYTES
            for at in np.split(np.arange(len(even)), np.flatnonzero(np.diff(portion)) + 1):
                for i, ids in zip(even[at].tolist(), self._spaced(lines.slice(at[0], len(at)).to_pylist())):
                    out[i] = ids
        return out

    def _spaced(self, lines: list[bytes]) -> list[np.ndarray]:
        self._make_room()
        # a space before each text ends the one before; the first unit of a text is looked up without it
        data = b" ".join([b"", *lines])
        cuts = _cuts(data)
        sizes = np.fromiter(map(len, lines), "i8", len(lines)) + 1
        first = np.searchsorted(cuts, np.cumsum(sizes) - sizes)
        ends = pa.py_buffer(np.append(cuts, len(data)).astype("i4"))
        units = pa.StringArray.from_buffers(len(cuts), ends, pa.py_buffer(data)).dictionary_encode()
        names, index = units.dictionary.to_numpy(zero_copy_only=False).tolist(), units.indices.to_numpy()
        enabled = gc.isenabled()
        gc.disable()  # many small objects without cycles
        try:
            at = self.units.places(names + [names[i][1:] for i in index[first].tolist()], self._learn)
        finally:
            if enabled:
                gc.enable()
        at, firsts = at[index], at[len(names) :]
        at[first] = firsts
        last = np.append(first[1:], len(at))
        ids, ends = self.units.joined(np.insert(at, last, self.units.known[None]))
        return np.split(ids, ends[last + np.arange(len(lines))][:-1])


def byte_spelling() -> dict[int, str]:
    """The character a byte-level model writes for each byte: itself if it is
    printable in Latin-1, else the next unused one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(path: str, end_id: int) -> Encoder:
    """One for each Python worker; tasks that follow find its table filled."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


# --- the file format -------------------------------------------------------

class FileWriter:
    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = 1):
        import zstandard

        self.out, self.frame_bytes = out, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.seek: list[bytes] = []
        self.index: list[np.ndarray] = []
        self.docs: list[tuple] = []
        self.held: list[bytes] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        data = ids.astype("<u4").tobytes()
        self.docs.append((doc_id or 0, doc_id is None, len(self.seek), self.size, len(ids)))
        self.held.append(data)
        self.size += len(data)
        if self.size >= self.frame_bytes:
            self._frame()

    def _frame(self) -> None:
        content = b"".join(self.held)
        frame = self.zstd.compress(content)
        self.out.write(frame)
        self.seek.append(_ENTRY.pack(len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.index.append(np.array(self.docs, _INDEX))
        self.held, self.docs, self.size = [], [], 0

    def close(self) -> None:
        if self.docs:
            self._frame()
        index = self.zstd.compress(np.concatenate([np.zeros(0, _INDEX), *self.index]).tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        # the index comes as an entry without content, so the sizes add up to the file
        self.seek.append(_ENTRY.pack(len(index) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        table = b"".join(self.seek) + _FOOTER.pack(len(self.seek), 0x80, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)


class Document(NamedTuple):
    doc_id: int | None
    ids: np.ndarray


class FileReader:
    """Reads the seek table and the index; decompresses frames on demand."""

    def __init__(self, file):
        import zstandard

        self.file, self.zstd = file, zstandard.ZstdDecompressor()
        end = file.size()
        frames, flags, magic = _FOOTER.unpack(self._at(end - _FOOTER.size, _FOOTER.size))
        if magic != SEEKABLE_MAGIC or not flags & 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        table = self._at(end - _FOOTER.size - frames * _ENTRY.size, frames * _ENTRY.size)
        self.frames = list(_ENTRY.iter_unpack(table))
        self.offsets = np.concatenate([[0], np.cumsum([f[0] for f in self.frames])]).astype("i8")
        index = self._at(int(self.offsets[-2]), self.frames[-1][0])
        self.index = np.frombuffer(self.zstd.decompress(index[8:]) if len(index) > 8 else b"", _INDEX)

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def frame(self, i: int) -> bytes:
        packed, size, checksum = self.frames[i]
        content = self.zstd.decompress(self._at(int(self.offsets[i]), packed), max_output_size=size)
        if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {i} does not match its checksum")
        return content

    def documents(self, wanted: set | None = None) -> Iterator[Document]:
        """In file order; frames without a wanted document are not read."""
        rows = self.index if wanted is None else self.index[np.isin(self.index["doc_id"], list(wanted)) & (self.index["null_id"] == 0)]
        at, content = -1, b""
        for doc_id, null_id, frame, offset, n in rows.tolist():
            if frame != at:
                at, content = frame, self.frame(frame)
            yield Document(None if null_id else doc_id, np.frombuffer(content, "<u4", n, offset))


# --- Spark -----------------------------------------------------------------

_MANIFEST = pa.schema([(n, pa.string() if n == "path" else pa.int64()) for n in ("file", "path", "n_docs", "n_tokens", "first_id", "last_id")])


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write(docs: DataFrame, tokenizer_path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text",
          end_id: int = END_ID, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Encode every row and write the files; returns the manifest, one row a
    file in id order: ``file``, ``path``, ``n_docs``, ``n_tokens``, ``first_id``,
    ``last_id`` and ``start`` (ids in the files before it)."""
    spark = docs.sparkSession
    prepare(spark)
    folder = folder or shared_folder(spark, "tokens")
    rows = texts(docs, id_col, text_col)
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        fs, base = _filesystem(folder)
        encoder, writer, draft = _encoder(tokenizer_path, end_id), None, ""
        n_docs, n_tokens, first, last = 0, 0, None, None
        for batch in batches:
            if not len(batch):
                continue
            if writer is None:
                fs.create_dir(base, recursive=True)
                draft = posixpath.join(base, f"_draft-{part:06d}-{uuid.uuid4().hex}")
                out = fs.open_output_stream(draft)
                writer = FileWriter(out, frame_bytes)
            for last, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text"))):
                first = last if first is None else first
                writer.add(last, ids)
                n_docs, n_tokens = n_docs + 1, n_tokens + len(ids)
        # the worker goes on to other tasks, which should not add theirs to what Arrow keeps
        pa.default_memory_pool().release_unused()
        if writer is not None:
            writer.close()
            out.close()
            path = posixpath.join(base, f"part-{part:06d}.zst")
            fs.move(draft, path)
            row = {"file": part, "path": posixpath.join(folder, f"part-{part:06d}.zst"), "n_docs": n_docs, "n_tokens": n_tokens, "first_id": first, "last_id": last}
            yield pa.RecordBatch.from_pylist([row], _MANIFEST)

    files = stage(dealt.mapInArrow(run, "file long, path string, n_docs long, n_tokens long, first_id long, last_id long"), "tokens-manifest")
    # one row a file, so one task can order them
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read(manifest: DataFrame) -> DataFrame:
    """Every document of the files: ``doc_id``, ``start`` (ids of all documents
    before it), ``n_tokens`` and ``ids_crc32`` (crc32 of its ids' bytes)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, start in zip(frame["path"], frame["start"]):
                fs, place = _filesystem(path)
                out = []
                with fs.open_input_file(place) as file:
                    for doc_id, ids in FileReader(file).documents():
                        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(out) == 10_000:
                            yield _rows(out)
                            out = []
                yield _rows(out)

    return _by_file(manifest.select("path", "start")).mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(manifest: DataFrame, wanted: Iterable[int]) -> DataFrame:
    """``doc_id`` and ``ids`` of the wanted documents; only files whose id range
    and frames whose index hold one are read."""
    ids = sorted(set(wanted))
    if not ids:
        return manifest.sparkSession.createDataFrame([], "doc_id long, ids array<long>")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                fs, place = _filesystem(path)
                with fs.open_input_file(place) as file:
                    for doc_id, found in FileReader(file).documents(set(ids)):
                        yield pd.DataFrame({"doc_id": [doc_id], "ids": [found.astype("i8")]})

    near = manifest.where((F.col("last_id") >= ids[0]) & (F.coalesce("first_id", F.lit(ids[0])) <= ids[-1]))
    return _by_file(near.select("path")).mapInPandas(run, "doc_id long, ids array<long>")


def _by_file(files: DataFrame) -> DataFrame:
    return files.repartition(max(1, files.count()))


def _rows(out: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
    frame["doc_id"] = pd.array([r[0] for r in out], "Int64")
    return frame
