"""Substring dedup: repeated word windows found with a count-min prefilter.

Pass one hashes every window of ``window`` words (XXH3, 96 bits). Each task
keeps a sketch of its windows as sorted counter numbers, which are merged into
one count-min sketch of two rows; only "two or more" of a counter is kept, one
bit, so the sketch has a fixed size of ``2 * 2**sketch_bits / 8`` bytes
whatever the input. Sketches only overestimate, so a window not estimated
repeated occurs in one document.

Pass two hashes again. A window repeated inside a task's chunk of documents is
settled there: all but the chunk's smallest document lose it. What the chunk's
smallest documents hold, if the sketch estimates it repeated, is grouped
exactly by hash over all chunks. A hot window thus sends one document a chunk.
The found places go back to the texts by a part of the id.

Windows and places travel as compressed arrays, a row for each task and slice
of the hash space. With inputs far larger than the sketch its estimates weaken
and more windows are grouped; results, memory and the linear cost stay.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pack, unpack, word_spans

WINDOW = 13
SKETCH_BITS = 28
ROWS = 2
SLICE_BITS = 22
#: Windows of a chunk, of a slice of the exact pass, and of a part of the texts.
CHUNK = 1_500_000
PER_SLICE = 2_000_000
PER_PART = 1_000_000
ENTRY = [("hi", "<u8"), ("lo", "<u4"), ("doc", "<i8"), ("pos", "<u4")]


def window_hashes(text: str | None, window: int) -> bytes:
    """16 bytes a window, in order; empty for texts of fewer words."""
    joined, starts, ends = word_spans(text)
    digest = xxhash.xxh3_128_digest
    return b"".join([digest(joined[a:b]) for a, b in
                     zip(starts[: len(starts) - window + 1].tolist(), ends[window - 1:].tolist())])


def chunks(batches, window: int):
    """Entries (hi, lo, doc, pos) of chunks of whole documents, sorted by hash,
    document and place. Documents without an id have no windows."""
    data, docs, counts, n = [], [], [], 0

    def close():
        h = np.frombuffer(b"".join(data), "<u8").reshape(-1, 2)
        e = {"hi": h[:, 0], "lo": h[:, 1].astype("<u4"), "doc": np.repeat(np.array(docs, "<i8"), counts),
             "pos": np.concatenate([np.arange(c, dtype="<u4") for c in counts])}
        order = np.lexsort((e["pos"], e["doc"], e["lo"], e["hi"]))
        return {k: v[order] for k, v in e.items()}

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if doc is None or not text:
                continue
            found = window_hashes(text, window)
            if found:
                data.append(found), docs.append(doc), counts.append(len(found) // 16)
                n += counts[-1]
            if n >= CHUNK:
                yield close()
                data, docs, counts, n = [], [], [], 0
    if n:
        yield close()


def first_of_hash(e: dict) -> np.ndarray:
    """True where a sorted entry's hash is new."""
    return np.r_[True, (e["hi"][1:] != e["hi"][:-1]) | (e["lo"][1:] != e["lo"][:-1])]


def counter(hi: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (hi >> np.uint64(32 * row)) & np.uint64((1 << bits) - 1)


def sketch_slices(batches, window: int, bits: int):
    """Rows (slice, n, counters): sorted counter numbers of a chunk, one a
    distinct window, two where two of its documents have the window."""
    step = min(SLICE_BITS, bits)
    for e in chunks(batches, window):
        new = first_of_hash(e)
        doc_first = e["doc"][new][np.cumsum(new) - 1]
        hi = e["hi"][new]
        again = np.logical_or.reduceat(e["doc"] != doc_first, np.flatnonzero(new))
        hi = np.concatenate([hi, hi[again]])
        for row in range(ROWS):
            c = np.sort(counter(hi, row, bits)).astype(np.uint32)
            cuts = np.searchsorted(c, np.arange(0, (1 << bits) + 1, 1 << step, dtype=np.uint64))
            out = [(row << (bits - step)) + s for s in range(len(cuts) - 1) if cuts[s + 1] > cuts[s]]
            parts = [c[a:b] & np.uint32((1 << step) - 1) for a, b in zip(cuts, cuts[1:]) if b > a]
            yield pa.RecordBatch.from_arrays([
                pa.array(out, pa.int32()), pa.array([len(e["hi"]) if row == 0 and i == 0 else 0
                                                     for i in range(len(out))], pa.int64()),
                pa.array([pack(np.diff(p, prepend=np.uint32(0))) for p in parts], pa.binary())],
                ["slice", "n", "counters"])


def build_sketch(docs: DataFrame, window: int, bits: int) -> tuple[bytes, int]:
    """The merged sketch (a bit a counter: two or more) and the number of windows."""
    step = min(SLICE_BITS, bits)

    def cut(batches):
        return sketch_slices(batches, window, bits)

    def merge(batches):
        at, seen, windows = None, None, 0

        def out():
            return pa.RecordBatch.from_arrays([
                pa.array([at], pa.int32()), pa.array([windows], pa.int64()),
                pa.array([np.packbits(seen >= 2, bitorder="little").tobytes()], pa.binary())],
                ["slice", "n", "bits"])
        for batch in batches:
            for s, n, data in zip(*[c.to_pylist() for c in batch.columns]):
                if s != at:
                    if at is not None:
                        yield out()
                    at, seen, windows = s, np.zeros(1 << step, np.uint8), 0
                c = np.cumsum(unpack(data, "<u4"), dtype=np.uint32)
                new = np.r_[True, c[1:] != c[:-1]]
                count = np.diff(np.r_[np.flatnonzero(new), len(c)])
                seen[c[new]] = np.minimum(seen[c[new]] + np.minimum(count, 2), 2)
                windows += n
        if at is not None:
            yield out()

    merged = (docs.mapInArrow(cut, "slice int, n long, counters binary")
              .repartition("slice").sortWithinPartitions("slice")
              .mapInArrow(merge, "slice int, n long, bits binary"))
    sketch, size, windows = bytearray(ROWS << max(0, bits - 3)), max(1, (1 << step) >> 3), 0
    for row in merged.toLocalIterator():  # 2**(bits - 22) rows a sketch row, of fixed size
        sketch[row["slice"] * size:(row["slice"] + 1) * size] = row["bits"]
        windows += row["n"]
    return bytes(sketch), windows


def estimated_repeated(hi: np.ndarray, sketch: np.ndarray, bits: int) -> np.ndarray:
    found = np.ones(len(hi), bool)
    for row in range(ROWS):
        c = counter(hi, row, bits) + np.uint64(row << bits)
        found &= (sketch[c >> np.uint64(3)] >> (c & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return found


def pack_entries(e: dict, pick) -> bytes:
    """The picked entries' columns, each with its length in front."""
    parts = [pack(np.ascontiguousarray(e[k][pick])) for k, _ in ENTRY]
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def unpack_entries(data: bytes) -> dict:
    out, at = {}, 0
    for k, kind in ENTRY:
        n = int.from_bytes(data[at:at + 8], "little")
        out[k], at = unpack(data[at + 8:at + 8 + n], kind), at + 8 + n
    return out


def places_by_part(doc: np.ndarray, pos: np.ndarray, parts: int) -> list[tuple[int, bytes, bytes]]:
    """(part, documents, places) rows of found places."""
    order = np.lexsort((pos, doc, doc % parts))
    doc, pos = doc[order], pos[order]
    part = doc % parts
    cuts = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)] if len(part) else [0]
    return [(int(part[a]), pack(doc[a:b]), pack(pos[a:b])) for a, b in zip(cuts, cuts[1:])]


def repeated_places(docs: DataFrame, window: int, bits: int, sketch: bytes, windows: int,
                    parts: int) -> DataFrame:
    """Rows (part, docs, places): where windows start that a smaller document has."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    slices = max(16, -(-windows // PER_SLICE))

    def spread(batches):
        held = np.frombuffer(shared.value, np.uint8)
        for e in chunks(batches, window):
            new = first_of_hash(e)
            later = e["doc"] != e["doc"][new][np.cumsum(new) - 1]  # settled in the chunk
            rows = [(-1 - p, d, x) for p, d, x in places_by_part(e["doc"][later], e["pos"][later], parts)]
            ask = np.flatnonzero(~later & estimated_repeated(e["hi"], held, bits))
            to = (e["hi"][ask] >> np.uint64(40)) % np.uint64(slices)
            order = np.argsort(to, kind="stable")
            ask, to = ask[order], to[order]
            cuts = np.r_[np.flatnonzero(np.r_[True, to[1:] != to[:-1]]), len(to)] if len(to) else [0]
            rows += [(int(to[a]), pack_entries(e, ask[a:b]), b"") for a, b in zip(cuts, cuts[1:])]
            for at in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([
                    pa.array([r[0] for r in rows[at:at + 64]], pa.int64()),
                    pa.array([r[1] for r in rows[at:at + 64]], pa.binary()),
                    pa.array([r[2] for r in rows[at:at + 64]], pa.binary())], ["slice", "a", "b"])

    def settle(held):
        e = {k: np.concatenate([h[k] for h in held]) for k, _ in ENTRY}
        order = np.lexsort((e["doc"], e["lo"], e["hi"]))
        e = {k: v[order] for k, v in e.items()}
        new = first_of_hash(e)
        later = e["doc"] != e["doc"][new][np.cumsum(new) - 1]
        return places_by_part(e["doc"][later], e["pos"][later], parts)

    def exact(batches):
        at, held = None, []

        def out(rows):
            return pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()),
                pa.array([r[2] for r in rows], pa.binary())], ["part", "docs", "places"])
        for batch in batches:
            passed = []
            for s, a, b in zip(*[c.to_pylist() for c in batch.columns]):
                if s < 0:  # settled before
                    passed.append((-1 - s, a, b))
                    continue
                if s != at and held:
                    yield out(settle(held))
                    held = []
                at = s
                held.append(unpack_entries(a))
            if passed:
                yield out(passed)
        if held:
            yield out(settle(held))

    return (docs.mapInArrow(spread, "slice long, a binary, b binary")
            .repartition("slice").sortWithinPartitions("slice")
            .mapInArrow(exact, "part long, docs binary, places binary"))


def keep_words(text: str | None, places: np.ndarray, window: int) -> tuple[int, int, str]:
    """Words, removed words and kept text for the places where removed windows start."""
    joined, starts, ends = word_spans(text)
    n, edge = len(starts), np.zeros(len(starts) + window + 1, np.int64)
    places = places[places + window <= n]
    np.add.at(edge, places, 1)
    np.add.at(edge, places + window, -1)
    keep = np.cumsum(edge)[:n] == 0
    if keep.all():
        return n, 0, joined.decode()
    # kept words in runs: each run is one slice of the joined text
    turn = np.flatnonzero(np.diff(np.r_[False, keep, False]))
    runs = [joined[starts[a]:ends[b - 1]] for a, b in zip(turn[::2], turn[1::2])]
    return n, int(n - keep.sum()), b" ".join(runs).decode()


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
          sketch_bits: int = SKETCH_BITS, digest_only: bool = False) -> DataFrame:
    """(id_col long, n_words, n_removed, kept_text), a row a row of ``docs``:
    each word goes that is covered by a window whose words also start in a
    document with a smaller id, judged on the input. The kept words are joined
    by one space. ``digest_only`` puts ``kept_sha256`` in the text's place.

    Null and empty texts have no words. Rows with a null id are kept whole and
    take nothing from others. Rows with one id are one document: nothing is a
    repeat of its own, and a place found in one of them goes in all of them.
    Other columns are ignored; an empty table gives an empty result.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketch, windows = build_sketch(slim, window, sketch_bits)
    parts = max(32, -(-windows // PER_PART)) | 1
    places = repeated_places(slim, window, sketch_bits, sketch, windows, parts)
    last = "kept_sha256" if digest_only else "kept_text"

    def apply(key, texts, found):
        doc = np.concatenate([unpack(x, "<i8") for x in found.column("docs").to_pylist()] or [np.zeros(0, "<i8")])
        pos = np.concatenate([unpack(x, "<u4") for x in found.column("places").to_pylist()] or [np.zeros(0, "<u4")])
        order = np.argsort(doc, kind="stable")
        doc, pos = doc[order], pos[order].astype(np.int64)
        ids, rows = texts.column("id").to_pylist(), []
        for i, text in zip(ids, texts.column("text").to_pylist()):
            a, b = (0, 0) if i is None else np.searchsorted(doc, [i, i + 1] if i < (1 << 63) - 1 else [i, i])
            n, gone, kept = keep_words(text, pos[a:b], window)
            rows.append((n, gone, hashlib.sha256(kept.encode()).hexdigest() if digest_only else kept))
        return pa.table({id_col: pa.array(ids, pa.int64()), "n_words": pa.array([r[0] for r in rows], pa.int64()),
                         "n_removed": pa.array([r[1] for r in rows], pa.int64()),
                         last: pa.array([r[2] for r in rows], pa.string())})

    part = F.coalesce(F.pmod("id", F.lit(parts)), F.pmod(F.xxhash64("text"), F.lit(parts))).cast("long")
    return (slim.withColumn("part", part).groupBy("part").cogroup(places.groupBy("part"))
            .applyInArrow(apply, f"`{id_col}` long, n_words long, n_removed long, {last} string"))
