"""Token-ID output: Arrow files of equal-length sequences.

Documents are ordered by range partitioning, encoded, closed with an end id
and laid end to end; each partition writes two Arrow IPC files into a shared
folder. ``*.tokens.arrow`` has fixed-size-list columns ``ids`` and ``mask``:
batches of equal-length sequences in flat buffers, so that a mapped file gives
sequence i without copying or parsing; only the last sequence of a file is
padded, where its mask is false. ``*.docs.arrow`` has each document's place.
Ids take the smallest unsigned type that holds the vocabulary. A task attempt
writes under a name of its own and the manifest names the attempt that
succeeded, so lost executors and retries leave nothing wrong behind.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path
from .common import worker_kept

SEQUENCE = 2048
END_ID = 2
#: Sequences a record batch of the file holds.
BATCH = 256
#: Strings whose ids a task keeps, and characters and bytes of strings and ids together, at most.
CACHE = 3 << 18
CACHE_BYTES = 64 << 20
#: File pairs a task reads back; a task of one spends more on its start than on the pair.
FILES_A_TASK = 4
TAIL = ".,;:!?"
#: A line feed between two visible characters.
LONE_FEED = re.compile(r"(?<=\S)\n(?=\S)")


class Kept(dict):
    """Ids by string, found on first use; emptied when full."""

    def __init__(self, find):
        super().__init__()
        self.find, self.held = find, 0

    def __missing__(self, key):
        found = self.find(key)
        size = len(key) + len(found or b"")
        if len(self) >= CACHE or self.held + size > CACHE_BYTES:
            self.clear()
            self.held = 0
        self[key] = found
        self.held += size
        return found


class Encoder:
    """Ids of whole texts by the tokenizers library, byte-level BPE.

    Such a tokenizer splits text before it merges bytes: at every single space
    and around every single line feed between two visible characters, and
    where a letter or digit meets a mark other than the apostrophe. Ids of the
    stretches between such places can be kept and joined. Texts with other
    white space next to a space or at an end, or with a special token's text,
    are encoded whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.bpe = self.whole.model.tokenize
        # the bytes' stand-ins in a byte-level vocabulary: visible Latin-1
        # characters for themselves, the rest from 256 on
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        self.stand_in = {b: 256 + i for i, b in enumerate(hidden)}
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        wide = self.whole.get_vocab_size() > 1 << 16
        self.dtype, self.code = (np.dtype("<u4"), "I") if wide else (np.dtype("<u2"), "H")
        #: Ids of a stretch after a space, and of one after another stretch.
        self.spaced, self.bare = Kept(lambda s: self._stretch(s, " ")), Kept(lambda s: self._stretch(s, ""))

    def _ids(self, text: str) -> bytes:
        return array(self.code, self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _stretch(self, part: str, lead: str) -> bytes | None:
        """Ids of ``lead`` and ``part``; None where it doesn't stand alone."""
        if not part or part != part.strip():
            return None
        if part.isalpha() and max(part) < "\u0250":
            piece = lead + part
            piece = ("\u0120" + part if lead else part) if part.isascii() else \
                piece.encode().decode("latin-1").translate(self.stand_in)
            return array(self.code, [t.id for t in self.bpe(piece)]).tobytes()
        # all lines in one go: a line has no such feed left, so the depth and the kept keys don't grow with the lines
        first, *rest = LONE_FEED.split(part)
        if rest:
            return self.feed.join([(self.spaced if lead else self.bare)[first], *map(self.bare.__getitem__, rest)])
        core = part.rstrip(TAIL)
        if core and core != part and core[-1].isalnum():
            first = (self.spaced if lead else self.bare)[core]
            return None if first is None else first + self.bare[part[len(core):]]
        return self._ids(lead + part)

    @property
    def feed(self) -> bytes:
        return self.bare.get("\n") or self.bare.setdefault("\n", self._ids("\n"))

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, self.dtype)
        if not any(s in text for s in self.special):
            first, *rest = text.split(" ")
            found = [self.bare[first], *map(self.spaced.__getitem__, rest)]
            if None not in found:
                return np.frombuffer(b"".join(found), self.dtype)
        return np.frombuffer(self._ids(text), self.dtype)


def _open(uri: str):
    """File system and path; the folder may be in any store that pyarrow opens."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"file://{uri}")


def _uri(folder: str) -> str:
    return "file://" + folder[5:] if folder.startswith("file:/") and not folder.startswith("file://") else folder


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None,
                 id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE,
                 end_id: int = END_ID) -> DataFrame:
    """Encode ``docs`` in ascending order of the id (nulls first; rows with one
    id by text, null first) and write the files. Returns the manifest (part int, tokens string,
    docs string, n_docs long, n_tokens long, n_sequences long), checkpointed:
    part is the place of a file in the order; partitions without rows have
    none. ``folder`` is on storage that all executors share (default: a new one
    in spark.checkpoint.dir); ``tokenizer`` is a local path on every executor.

    Null and empty texts are documents of the end id alone. Repeated rows are
    written as often as they come in, other columns are ignored, and an empty
    table gives an empty manifest."""
    folder = _uri(folder or scratch_path(docs.sparkSession, "tokens"))

    def write(batches):
        part, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        encoder = worker_kept(f"tokens {tokenizer}", lambda: Encoder(tokenizer))
        kind = pa.uint16() if encoder.dtype.itemsize == 2 else pa.uint32()
        schema = pa.schema([("ids", pa.list_(kind, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        fs, base = _open(folder)
        paths = [f"{base}/part-{part:06d}-{name}.{what}.arrow" for what in ("tokens", "docs")]
        sink = writer = None
        block, held, n_held, total, sequences = sequence * BATCH, [], 0, 0, 0
        ids, starts, lengths = [], [], []

        def put(flat, real):
            mask = np.zeros(len(flat), bool)
            mask[:real] = True
            writer.write_batch(pa.RecordBatch.from_arrays([
                pa.FixedSizeListArray.from_arrays(pa.array(flat, kind), sequence),
                pa.FixedSizeListArray.from_arrays(pa.array(mask), sequence)], schema=schema))

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    sink = fs.open_output_stream(paths[0])
                    writer = pa.ipc.new_file(sink, schema)
                row = np.append(encoder.encode(text), encoder.dtype.type(end_id))
                ids.append(doc), starts.append(total), lengths.append(len(row))
                total += len(row)
                held.append(row)
                n_held += len(row)
                if n_held >= block:
                    flat = np.concatenate(held)
                    full = len(flat) // block * block
                    for at in range(0, full, block):
                        put(flat[at:at + block], block)
                    sequences += full // sequence
                    held, n_held = [flat[full:]], len(flat) - full
        if writer is None:
            return
        if n_held:
            flat = np.concatenate(held)
            n = -(-n_held // sequence)
            put(np.append(flat, np.zeros(n * sequence - n_held, encoder.dtype)), n_held)
            sequences += n
        writer.close()
        sink.close()
        places = pa.record_batch([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()),
                                  pa.array(lengths, pa.int64())], ["id", "start", "n_tokens"])
        with fs.open_output_stream(paths[1]) as out, pa.ipc.new_file(out, places.schema) as w:
            for at in range(0, places.num_rows, 1 << 16):
                w.write_batch(places.slice(at, 1 << 16))
        names = [f"{folder}/{p.rsplit('/', 1)[1]}" for p in paths]
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "tokens": names[:1], "docs": names[1:],
            "n_docs": [len(ids)], "n_tokens": [total], "n_sequences": [sequences]})

    ordered = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
               .repartitionByRange(F.col("id").asc_nulls_first())
               .sortWithinPartitions(F.col("id").asc_nulls_first(), F.col("text").asc_nulls_first()))
    return cut_lineage(ordered.mapInArrow(
        write, "part int, tokens string, docs string, n_docs long, n_tokens long, n_sequences long"))


class TokenFile:
    """One file pair. ``sequence(i)`` and ``document(i)`` take ids straight from
    the mapped file's buffers where the store is a local disk."""

    def __init__(self, tokens: str, docs: str):
        def reader(uri):
            fs, path = _open(uri)
            source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
            return pa.ipc.open_file(source)
        self.file, self.places = reader(tokens), reader(docs).read_all()
        self.length = self.file.schema.field("ids").type.list_size
        self.batch = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask of sequence i."""
        batch = self.file.get_batch(i // self.batch)
        at = i % self.batch
        ids = batch.column(0).values.slice(at * self.length, self.length)
        return ids.to_numpy(zero_copy_only=True), batch.column(1).values.slice(at * self.length, self.length)

    def span(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from place ``start`` of the file."""
        block, out = self.batch * self.length, []
        for b in range(start // block, -(-(start + n) // block)):
            flat = self.file.get_batch(b).column(0).values.to_numpy(zero_copy_only=True)
            out.append(flat[max(0, start - b * block): start + n - b * block])
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint16)


def read_documents(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Read the files back: (id_col long, start long, n_tokens long, ids_crc32
    long) a document, in which start counts the ids of all documents before it
    and ids_crc32 is over its ids as little-endian unsigned 32-bit integers.
    A task reads FILES_A_TASK file pairs or so; only the manifest is ordered in one."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # the number is given, so the few small rows of the manifest stay apart
    files = (manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
             .select("part", "tokens", "docs", "before").repartitionByRange(-(-manifest.count() // FILES_A_TASK) or 1, "part"))

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                file = TokenFile(row["tokens"], row["docs"])
                for places in file.places.to_batches():
                    starts, lengths = places.column(1).to_numpy(), places.column(2).to_numpy()
                    crc = [zlib.crc32(file.span(s, n).astype("<u4").tobytes())
                           for s, n in zip(starts.tolist(), lengths.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [places.column(0), pa.array(starts + row["before"]), places.column(2),
                         pa.array(crc, pa.int64())], [id_col, "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(read, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")


def drop_files(manifest: DataFrame) -> None:
    """Delete the files a manifest names, in tasks; files that are gone are passed over."""
    def drop(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist() + batch.column(1).to_pylist():
                fs, path = _open(uri)
                if fs.get_file_info(path).type != pafs.FileType.NotFound:
                    fs.delete_file(path)
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})
    manifest.select("tokens", "docs").mapInArrow(drop, "n long").agg(F.sum("n")).collect()
