"""Token ids of whole texts, and flat binary files of them.

Texts are encoded by the tokenizers library. Both vocabularies used here merge within
space-separated units only, so a batch of texts is split into units with Arrow, the library
encodes each distinct unit that the worker does not remember, and a text is the concatenation
of its units. A text in which a cut might not be safe goes to the library whole.

File format, for each partition of documents in ascending id order:

* ``NAME.bin``: the ids of all documents, unsigned little-endian integers of 2 bytes where
  the vocabulary has at most 65,536 ids, else 4;
* ``NAME.idx``: 64-bit little-endian offsets, one a document and the end (count + 1);
* ``NAME.ids``: 64-bit little-endian document ids, 0 for the ``n_null`` first, whose id is null.

A table names the files that count, with documents, tokens and the base: how many tokens
lie before the file, from a prefix sum over the files. Tasks write under a name of their
own attempt, so a lost or repeated task leaves no half file among those named.
"""

from __future__ import annotations

import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, batches, slices

#: Units, and bare words, that a worker remembers, and the longest unit that it remembers.
CACHE, LONGEST = 200_000, 48
#: Characters of text that are split at one time.
BATCH_CHARS = 2 << 20
#: White space where a cut before a space or a line end may fall within a token.
RUNS = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]{3}|[\s\p{Z}\x{1c}-\x{1f}\x{85}]{2}$"
#: Marks that may end a word of Latin letters: letters and marks are tokens apart.
MARKS = ".,;:!?#$%&*"
LATIN = {c for c in map(chr, range(0x100)) if c.isalpha() and (c.isascii() or c >= "À")}

_encoders: dict[str, Encoder] = {}


class Units(dict):
    """Ids of a unit as bytes; an unknown one goes to the library, plain words without its pre-tokenizer."""

    def __init__(self, enc: Encoder):
        super().__init__()
        self.enc, self.words = enc, {}

    def __missing__(self, unit: str) -> bytes:
        word, marks = self._simple(unit) if self.enc.shortcut else (None, "")
        if word is None:
            ids = self.enc.whole(unit)
        else:
            ids = self.words.get(word)
            if ids is None:
                ids = self.enc.word(word)
                if len(self.words) < CACHE and len(word) <= LONGEST:
                    self.words[word] = ids
            if marks:
                ids += self.get(marks) or self.setdefault(marks, self.enc.whole(marks))
        if len(self) < CACHE and len(unit) <= LONGEST:
            self[unit] = ids
        return ids

    def _simple(self, unit: str) -> tuple[str | None, str]:
        """The word (with its space, in lower case if the vocabulary wants it) and its punctuation."""
        word = unit.rstrip(MARKS)
        bare = word[1:] if word[:1] == " " else word
        if not bare.isalpha() or not (bare.isascii() or LATIN.issuperset(bare)):
            return None, ""
        return word.lower() if self.enc.drops_space else word, unit[len(word) :]


class Encoder:
    """Encodes texts to ids; ``drops_space``: the vocabulary lower-cases and ignores white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.drops_space = not self.whole(" \n\t")
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {ord(c): level.pre_tokenize_str(c)[0][0] for c in {" ", *LATIN}}
        lower = str.lower if self.drops_space else str
        self.shortcut = all(self.word(lower(w)) == self.whole(w) for w in ("the", "Größe", "LEÇON", "xqzjv", "Ñandú", *([] if self.drops_space else [" the", " Àÿ"])))
        self.units = Units(self)

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def word(self, word: str) -> bytes:
        """One word's ids from the library's model, given the bytes as its alphabet has them."""
        if not word.isascii():
            word = word.translate(self.letters)
        elif word[0] == " ":
            word = self.letters[32] + word[1:]
        return array(self.dtype.char, [t.id for t in self.tok.model.tokenize(word)]).tobytes()

    def _split(self, texts: pa.Array) -> pa.Array:
        """Lists of pieces; a piece stands for itself after one space, except where it starts a line or a text."""
        if self.drops_space:
            return pc.ascii_split_whitespace(texts)  # ASCII white space only: other kinds are the library's to judge
        return pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")

    def encode(self, texts: pa.Array) -> pa.Array:
        """The ids of each text as large binary of ``dtype``; none for null."""
        texts = pc.fill_null(texts, "")
        apart = np.zeros(len(texts), bool) if self.drops_space else pc.match_substring_regex(texts, RUNS).to_numpy(zero_copy_only=False)
        lists = self._split(pc.if_else(pa.array(apart), "", texts))
        cuts, coded = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().dictionary_encode()
        codes, units = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        if self.drops_space:
            units = units.to_pylist()
        else:
            first = coded.take(pa.array(cuts[:-1])).to_pylist()  # every text has a piece
            units = pc.if_else(pc.starts_with(units, "\n"), units, pc.binary_join_element_wise(" ", units, "")).to_pylist()
            own = {f: i for i, f in enumerate(dict.fromkeys(first), len(units))}
            codes = codes.copy()
            codes[cuts[:-1]] = [own[f] for f in first]
            units += own
        got = pa.array(list(map(self.units.__getitem__, units)), pa.large_binary()).take(pa.array(codes))
        ends = np.frombuffer(got.buffers()[1], np.int64)[: len(codes) + 1] if len(codes) else np.zeros(1, np.int64)
        data = got.buffers()[2] if len(codes) else pa.py_buffer(b"")
        out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(ends[cuts])), data])
        if apart.any():
            whole = [self.whole(texts[int(i)].as_py()) for i in np.flatnonzero(apart)]
            out = pc.replace_with_mask(out, pa.array(apart), pa.array(whole, pa.large_binary()))
        return out

    def batches(self, texts: pa.Array, end: bytes = b""):
        """(i, j, blobs): the ids of rows i to j - 1 as bytes, each with ``end`` behind it."""
        for i, j in slices(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False), BATCH_CHARS):
            yield i, j, [b + end for b in self.encode(texts.slice(i, j - i)).to_pylist()]


def dtype_of(path: str) -> np.dtype:
    """The integers that hold a vocabulary's ids."""
    return encoder(path).dtype


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def crc_u32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def store(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and path of a folder; local folders as file:// or a plain path."""
    return pyarrow.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


MANIFEST = "file string, width int, first_id long, n_null long, n_docs long, n_tokens long"
#: Documents whose offsets are read at one time.
READ_DOCS = 1_000


def write_files(docs: DataFrame, scratch: Scratch, vocabulary: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Encodes and writes all documents; returns the table of files with their ``base``.

    ``end_id`` is appended to each document. Documents are dealt by ranges of their id and
    sorted within, so files follow one another. A null text has no ids but ``end_id``; null
    ids come first; rows that repeat an id, or have none, follow one another in order of
    their text. An empty table gives an empty table of files.
    """
    folder = folder or scratch.path("token-files")

    def run(stream):
        enc = encoder(vocabulary)
        end = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        fs, base = store(folder)
        name, n_null, n_docs, n_tokens, first = None, 0, 0, 0, None
        files: list = []
        for batch in stream:
            ids, texts = batch.column(0), batch.column(1)
            if not len(ids):
                continue
            if name is None:
                name, first = f"{base}/{uuid.uuid4().hex}", ids[0].as_py()
                fs.create_dir(base, recursive=True)
                files = [fs.open_output_stream(f"{name}.{x}") for x in ("bin", "idx", "ids")]
            for _, _, blobs in enc.batches(texts, end):
                sizes = np.array([len(b) // enc.dtype.itemsize for b in blobs], "<i8")
                files[0].write(b"".join(blobs))
                files[1].write((n_tokens + np.cumsum(sizes) - sizes).astype("<i8").tobytes())
                n_tokens += int(sizes.sum())
            files[2].write(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            n_null, n_docs = n_null + ids.null_count, n_docs + len(ids)
        if name is not None:
            files[1].write(np.array([n_tokens], "<i8").tobytes())
            for f in files:
                f.close()
            yield pa.RecordBatch.from_pylist([{"file": name, "width": enc.dtype.itemsize, "first_id": first, "n_null": n_null, "n_docs": n_docs, "n_tokens": n_tokens}], pa.schema([("file", pa.string()), ("width", pa.int32()), ("first_id", pa.int64()), ("n_null", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    manifest = d.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, MANIFEST)
    manifest = scratch.write(manifest.withColumn("folder", F.lit(folder)), "files")
    before = Window.orderBy("first_id").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


class TokenFile:
    """One partition's files: memory-mapped where the store is local, else read by ranges."""

    def __init__(self, folder: str, name: str, width: int, n_docs: int, n_null: int = 0):
        self.fs, _ = store(folder)
        self.name, self.n_docs, self.n_null = name, n_docs, n_null
        self.kinds = {"bin": np.dtype(f"<u{width}"), "idx": np.dtype("<i8"), "ids": np.dtype("<i8")}
        self.local = isinstance(self.fs, pyarrow.fs.LocalFileSystem)
        self._open: dict = {}

    def part(self, which: str, a: int, b: int) -> np.ndarray:
        """Elements a to b - 1 of one of the three files."""
        kind = self.kinds[which]
        if a >= b:
            return np.zeros(0, kind)
        if which not in self._open:
            path = f"{self.name}.{which}"
            self._open[which] = np.memmap(path, kind, "r") if self.local else self.fs.open_input_file(path)
        if self.local:
            return self._open[which][a:b]
        return np.frombuffer(self._open[which].read_at((b - a) * kind.itemsize, a * kind.itemsize), kind)

    def __len__(self) -> int:
        return self.n_docs

    def __getitem__(self, i: int) -> np.ndarray:
        return self.part("bin", *self.part("idx", i, i + 2))

    def doc_ids(self, a: int, b: int) -> pa.Array:
        return pa.array(np.asarray(self.part("ids", a, b)), mask=np.arange(a, b) < self.n_null)


def read_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files; one task a file."""

    def run(batch: pa.RecordBatch):
        for r in batch.to_pylist():
            f = TokenFile(r["folder"], r["file"], r["width"], r["n_docs"], r["n_null"])
            for at in range(0, len(f), READ_DOCS):
                to = min(at + READ_DOCS, len(f))
                off = np.asarray(f.part("idx", at, to + 1))
                crc = [crc_u32(f.part("bin", a, b)) for a, b in zip(off, off[1:])]
                yield pa.RecordBatch.from_arrays([f.doc_ids(at, to), pa.array(off[:-1] + r["base"]), pa.array(np.diff(off)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    one_each = files.repartition(max(1, files.count()))
    return one_each.mapInArrow(batches(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
