"""Removal of passages that repeat from an earlier document, by relative Lempel-Ziv parsing.

The reference is the whole corpus, in blocks: a block is an index of the phrases of `k`
words that hash to it, with the first place of each phrase in the document of least id
that has it.  Every document is looked up in every block that has its phrases, which
gives, for each place of the document, a place in the reference where the same
phrase stands earlier.  Parsing is greedy: the first such place begins a factor
(source document, source place, length), which grows word by word as long as the same
source goes on; the next factor begins at the next place found.  All phrases are
looked up, those across the ends of factors and of blocks included, so no repeat of `k`
words is lost where one factor ends and another begins.

Phrases are looked up by hash.  Each factor is then held against its source's own words:
the target's task sends a 16-byte digest of the factor's words to the chunk of rows where the
source lies (equal requests only once, however many documents hold the passage), and that
chunk's task compares it with the digest of its own words.  If any differ, everything is parsed
again under other hashes, so hashes can cost time but not a wrong word.

Documents stay where their files are.  What moves is 8 bytes a phrase with its place and
document id, and back come the places of found phrases with their sources.  The block is drawn from
a second hash, whose bits add to the 64 that are sent.  A phrase held by a third
of all rows is one key of one block and is never paired up.

Cases: a null or empty text, or one of fewer than `k` words, loses nothing; equal
texts lose all but the smallest id's; rows with equal ids do not remove each
other's words; a null id counts as larger than all others; very long texts are parsed whole;
an empty table gives no rows; further columns, whatever they are called, are kept by
`dedup_text` and ignored by `dedup`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textcore as tc
from graphloom.llm.places import CHUNK, Kept, chunk_of, keep, matched, runs
from graphloom.llm.shared import FILE, ROW, input_bytes, located, map_arrow, shared_dir, written

K = 13
SLICE = 4 << 20
BLOCK_BYTES = 12 << 20  # of phrases in one index block, and more for inputs over about 30 GB
LAST = np.iinfo(np.int64).max
SEEDS = 4


def _ids(b: pa.RecordBatch) -> np.ndarray:
    return tc.column(b, "doc_id").cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)


def _spots(size: np.ndarray, widths: list[int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """Column, byte and places of each byte plane, for cells of `size` items that hold one column's planes after the other's."""
    width = sum(widths)
    at, step, plane = tc.ragged((np.cumsum(size) - size) * width, size), np.repeat(size, size), 0
    for c, w in enumerate(widths):
        for k in range(w):
            yield c, k, at + plane * step
            plane += 1


def _planes(columns: list[tuple[np.ndarray, str]], size: np.ndarray) -> pa.Array:
    """One binary a cell: numbers as byte planes, of which the shuffle's compression all but removes those that hardly change.  All cells at once, as there are many small ones."""
    widths = [np.dtype(kind).itemsize for _, kind in columns]
    raw = [np.ascontiguousarray(x.astype(kind)).view(np.uint8).reshape(len(x), w) for (x, kind), w in zip(columns, widths, strict=True)]
    out = np.empty(int(size.sum()) * sum(widths), np.uint8)
    for c, k, at in _spots(size, widths):
        out[at] = raw[c][:, k]
    return _binary(out, size * sum(widths))


def _unplanes(cells: pa.Array, kinds: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns of all cells, and how many items each cell has."""
    widths = [np.dtype(kind).itemsize for kind in kinds]
    data, size = _bytes(cells)
    size = size // sum(widths)
    raw = [np.empty((int(size.sum()), w), np.uint8) for w in widths]
    for c, k, at in _spots(size, widths):
        raw[c][:, k] = data[at]
    return [x.view(kind).ravel() for x, kind in zip(raw, kinds, strict=True)], size


def _binary(data: np.ndarray, size: np.ndarray) -> pa.Array:
    off = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(off), pa.py_buffer(data)]).cast(pa.binary())


def _bytes(cells: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all cells in a row, and each cell's length."""
    parts = [x.cast(pa.large_binary()) for x in (cells.chunks if isinstance(cells, pa.ChunkedArray) else [cells]) if len(x)]
    data, size = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)]
    for x in parts:
        off = np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1]
        size.append(np.diff(off))
        if off[-1] > off[0]:
            data.append(np.frombuffer(x.buffers()[2], np.uint8)[off[0] : off[-1]])
    return np.concatenate(data) if len(data) > 2 else data[-1], np.concatenate(size)


def _blocks(total: int) -> int:
    """Blocks grow with the root of the input beyond 30 GB, so that a slice's share of a block stays more than its row's overhead."""
    return max(1, -(-total * 3 // max(BLOCK_BYTES, int(72 * total**0.5))))


def _found(rows: DataFrame, k: int, seed: int, total: int) -> DataFrame:
    """file, chunk, and packed columns: row and place of phrases that an earlier document has, with file, row and place of the first."""
    blocks = _blocks(total)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, buf, off in tc.slices(runs(batches), limit=SLICE):
            starts, ends, wo = tc.spans(buf, off)
            at, per = tc.ngram_rows(wo, k)
            if not len(at):
                continue
            h = tc.span_hashes(buf, starts, ends, seed=seed)
            grams = tc.ngrams(h, k)[at]
            block = ((tc.ngrams(h, k, 0xA24BAED4963EE407)[at] >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
            doc = np.repeat(np.arange(len(per)), per)
            order = np.argsort(block.astype(np.uint16 if blocks < 65536 else np.int64), kind="stable")
            block, doc, place = block[order], doc[order], (at - wo[doc])[order]
            cell = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            run = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (doc[1:] != doc[:-1])]))  # phrases of one document in one block
            step = np.diff(place, prepend=0)
            step[run] = place[run]
            size = np.diff(np.append(run, len(doc)))
            which = doc[run]
            ids, row = _ids(b)[which], (tc.int64(b, ROW) % CHUNK)[which]
            grams = grams[order]
            per_cell = np.diff(np.append(cell, len(doc)))
            runs_of = np.diff(np.append(np.searchsorted(run, cell), len(run)))
            file, chunk = chunk_of(b)
            n = len(cell)
            yield pa.record_batch(
                [
                    pa.array(block[cell]),
                    pa.array([file] * n),
                    pa.array([chunk] * n, pa.int64()),
                    _planes([(ids, "<i8"), (row, "<u2"), (size, "<u4")], runs_of),
                    _binary(grams.view(np.uint8), per_cell * 8),
                    _planes([(step, "<u4")], per_cell),
                ],
                names=["block", "file", "chunk", "docs", "grams", "places"],
            )

    def look_up(table: pa.Table) -> pa.Table:
        """All phrases of one block: which an earlier document has, and where."""
        t = table.combine_chunks()
        grams = _bytes(t["grams"])[0].view(np.uint64)
        (steps,), per_cell = _unplanes(t["places"], ["<u4"])
        (run_id, run_row, run_size), runs_of = _unplanes(t["docs"], ["<i8", "<u2", "<u4"])
        size = run_size.astype(np.int64)
        ids, row, cell = np.repeat(run_id, size), np.repeat(run_row, size), np.repeat(np.arange(len(per_cell), dtype=np.int32), per_cell)
        total, first = np.cumsum(steps, dtype=np.int64), np.cumsum(size) - size
        place = (total - np.repeat(total[first] - steps[first], size)).astype(np.uint32)
        cut = np.concatenate([[0], np.cumsum(per_cell)])
        del steps, total, run_id, run_row, run_size, runs_of, first, size
        order = np.argsort(grams, kind="stable")
        grams = grams[order]
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        count = np.diff(np.append(first, len(grams)))
        del grams
        order = order[np.repeat(count > 1, count)]  # phrases that come once end here
        count = count[count > 1]
        own = ids[order]
        begin = np.cumsum(count) - count
        least = np.repeat(np.minimum.reduceat(own, begin), count) if len(own) else own
        source = np.repeat(np.minimum.reduceat(np.where(own == least, order, len(ids)), begin), count) if len(own) else order
        later = own > least
        hit, source = order[later], source[later]
        turn = np.argsort(hit, kind="stable")
        hit, source = hit[turn], source[turn]
        files, chunks = t["file"].dictionary_encode().combine_chunks(), t["chunk"].to_numpy()
        number = files.indices.to_numpy()
        hits = np.diff(np.searchsorted(hit, cut))
        some = np.flatnonzero(hits)
        hits = hits[some]
        # the files of each cell's sources, and which of them each source is in
        names, at = np.unique(np.repeat(np.arange(len(some)), hits) * len(files.dictionary) + number[cell[source]], return_inverse=True)
        begin = np.searchsorted(names, np.arange(len(some) + 1) * len(files.dictionary))
        data = _planes([(row[hit], "<u2"), (place[hit], "<u4"), (at - np.repeat(begin[:-1], hits), "<u2"), (chunks[cell[source]] * CHUNK + row[source], "<u4"), (place[source].astype(np.int64) - place[hit], "<i4")], hits)
        name = files.dictionary
        sources = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), name.take(pa.array(names % max(1, len(name)), pa.int32())))
        return pa.table([name.take(pa.array(number[some], pa.int32())), pa.array(chunks[some]), sources, data], names=["file", "chunk", "sources", "data"])

    cells = map_arrow(rows, phrases, "block long, file string, chunk long, docs binary, grams binary, places binary")
    return cells.groupBy("block").applyInArrow(look_up, "file string, chunk long, sources array<string>, data binary")


def factors(row: np.ndarray, place: np.ndarray, file: np.ndarray, source_row: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greedy parse of found places: where (in row and place order) each factor begins, and how many phrases it has.  A factor goes on while the next place is found in the same document, one word further."""
    go_on = (row[1:] == row[:-1]) & (place[1:] == place[:-1] + 1) & (file[1:] == file[:-1]) & (source_row[1:] == source_row[:-1]) & (shift[1:] == shift[:-1])
    first = np.flatnonzero(np.concatenate([[True], ~go_on]))[: len(row)]
    return first, np.diff(np.append(first, len(row)))


def _store(folder: str, k: int):
    def store(key: tuple, table: pa.Table) -> pa.Table:
        """The factors of one chunk of rows, in its side file."""
        file, chunk = (x.as_py() for x in key)
        t = table.combine_chunks()
        (row, place, at, source_row, shift), hits = _unplanes(t["data"], ["<u2", "<u4", "<u2", "<u4", "<i4"])
        per_cell = pa.compute.list_value_length(t["sources"]).to_numpy()
        coded = pa.compute.list_flatten(t["sources"]).combine_chunks().dictionary_encode()
        order = np.argsort(np.array(coded.dictionary.to_pylist(), dtype=np.str_))
        names, rank = [coded.dictionary[int(i)].as_py() for i in order], np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        source = rank[coded.indices.to_numpy()[np.repeat(np.cumsum(per_cell) - per_cell, hits) + at]]
        order = np.argsort(row.astype(np.int64) << 40 | place)
        row, place, source, source_row, shift = (x[order].astype(np.int64) for x in (row, place, source, source_row, shift))
        first, n = factors(row, place, source, source_row, shift)
        keep(folder, file, chunk, row=row[first], place=place[first], words=n + k - 1, source=source[first], source_row=source_row[first], source_place=place[first] + shift[first], files=np.array(names, dtype=np.str_))
        return pa.table({"n": pa.array([len(first)], pa.int64())})

    return store


def _plain(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """All words with one space behind each, and where each begins (and the last ends)."""
    size = ends - starts + 1
    at = np.append(starts, len(buf))
    tight = len(starts) and (at[1:-1] == ends[:-1] + 1).all() and starts[0] == 0 and ends[-1] >= len(buf) - 1
    raw = np.append(buf, np.uint8(32))
    raw = np.where(tc.SPACE[raw], np.uint8(32), raw)
    if not tight:
        raw = raw[tc.ragged(starts, size)]
    return raw.tobytes(), np.concatenate([[0], np.cumsum(size)])


def _digests(plain: bytes, to: np.ndarray, first: np.ndarray, words: np.ndarray) -> list[bytes]:
    """Digest of each range of words, joined by one space."""
    return [hashlib.blake2b(plain[a : b - 1], digest_size=16).digest() for a, b in zip(to[first].tolist(), to[first + words].tolist(), strict=True)]


def _verify(rows: DataFrame, folder: str) -> bool:
    """Whether the words of every factor are those of its source."""
    asked = folder + "-asked"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Kept(folder)
        for b, buf, off in tc.slices(runs(batches), limit=2 << 20):
            d = kept.of(b)
            if not d:
                continue
            use, doc = matched(b, d["row"])
            if not len(use):
                continue
            starts, ends, wo = tc.spans(buf, off)
            got = _digests(*_plain(buf, starts, ends), wo[doc] + d["place"][use], d["words"][use])
            cols = [pa.array(d["files"][d["source"][use]]), *(pa.array(d[c][use]) for c in ("source_row", "source_place", "words")), pa.array(got, pa.binary())]
            yield pa.record_batch(cols, names=["file", "row", "place", "words", "digest"])

    def store(key: tuple, table: pa.Table) -> pa.Table:
        file, chunk = (x.as_py() for x in key)
        raw = np.frombuffer(b"".join(table["digest"].to_pylist()), "V16")
        keep(asked, file, chunk, row=table["row"].to_numpy() % CHUNK, place=table["place"].to_numpy(), words=table["words"].to_numpy(), digest=raw)
        return pa.table({"n": pa.array([table.num_rows], pa.int64())})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, equal, n = Kept(asked), 0, 0
        for b, buf, off in tc.slices(runs(batches), limit=2 << 20):
            d = kept.of(b)
            if not d:
                continue
            use, doc = matched(b, d["row"])
            if len(use):
                starts, ends, wo = tc.spans(buf, off)
                first, words = wo[doc] + d["place"][use], d["words"][use]
                inside = first + words <= wo[doc + 1]
                got = np.frombuffer(b"".join(_digests(*_plain(buf, starts, ends), first[inside], words[inside])), "V16")
                equal += int((got == d["digest"][use[inside]]).sum())
                n += len(use)
        yield pa.record_batch([pa.array([n], pa.int64()), pa.array([equal], pa.int64())], names=["n", "equal"])

    requests = map_arrow(rows, ask, "file string, row long, place long, words long, digest binary").distinct()
    sent = written(requests.withColumn("chunk", (F.col("row") / CHUNK).cast("long")).groupBy("file", "chunk").applyInArrow(store, "n long"))
    want = sent.agg(F.sum("n")).first()[0] or 0
    n, equal = (x or 0 for x in map_arrow(rows, compare, "n long, equal long").agg(F.sum("n"), F.sum("equal")).first())
    if n != want:
        raise RuntimeError(f"{want} factors were to be verified, {n} were found")
    return n == equal


def parse(docs: DataFrame, k: int = K, doc: str = "doc_id", text: str = "text") -> str:
    """Finds all factors of located docs and leaves them in a folder, one file for each chunk of input rows."""
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), FILE, ROW)
    for seed in range(SEEDS):
        folder = f"{shared_dir(docs.sparkSession)}/factors"
        written(_found(rows, k, seed, input_bytes(docs)).groupBy("file", "chunk").applyInArrow(_store(folder, k), "n long"))
        if _verify(rows, folder):
            return folder
    raise RuntimeError("factors differ from their sources under every hash")


def _marked(b: pa.RecordBatch, buf: np.ndarray, off: np.ndarray, kept: Kept):
    starts, ends, wo = tc.spans(buf, off)
    edge = np.zeros(len(starts) + 1, np.int32)
    if d := kept.of(b):
        use, doc = matched(b, d["row"])
        np.add.at(edge, wo[doc] + d["place"][use], 1)
        np.add.at(edge, wo[doc] + d["place"][use] + d["words"][use], -1)
    return starts, ends, wo, np.cumsum(edge[:-1]) > 0


def dedup(docs: DataFrame, k: int = K, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) of every document."""
    docs = located(docs)
    folder = parse(docs, k, doc, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_ = Kept(folder)
        for b, buf, off in tc.slices(runs(batches), limit=2 << 20):
            starts, ends, wo, gone = _marked(b, buf, off, kept_)
            kept = np.flatnonzero(~gone)
            ko = np.searchsorted(kept, wo)
            plain, at = _plain(buf, starts[kept], ends[kept])
            to = at[ko].tolist()
            sha = [hashlib.sha256(plain[x : max(x, y - 1)]).hexdigest() for x, y in zip(to[:-1], to[1:], strict=True)]
            n = np.diff(wo)
            yield pa.record_batch([tc.column(b, "doc_id"), pa.array(n), pa.array(n - np.diff(ko)), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), FILE, ROW)
    return map_arrow(rows, run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup_text(docs: DataFrame, k: int = K, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, all columns, with the removed words (each with the white space after it) gone from the text."""
    names, schema, docs = docs.columns, docs.schema, located(docs)
    folder = parse(docs, k, doc, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_ = Kept(folder)
        for b, buf, off in tc.slices(runs(batches), text=text, limit=2 << 20):
            starts, _, wo, gone = _marked(b, buf, off, kept_)
            edge = np.zeros(len(buf) + 1, np.int32)
            bad = np.flatnonzero(gone)
            if len(bad):
                stop = np.append(starts[1:], len(buf))
                stop[wo[1:][wo[1:] > wo[:-1]] - 1] = off[1:][wo[1:] > wo[:-1]]
                np.add.at(edge, starts[bad], 1)
                np.add.at(edge, stop[bad], -1)
            stay = np.cumsum(edge[:-1]) == 0
            kept = buf[stay].tobytes()
            to = np.concatenate([[0], np.cumsum(stay)])[off].tolist()
            old, touched = tc.column(b, text), np.diff(np.array(to)) < np.diff(off)
            new = pa.array([kept[x:y].decode("utf-8", "replace") if t else None for x, y, t in zip(to[:-1], to[1:], touched.tolist(), strict=True)], pa.string())
            yield pa.record_batch([pa.compute.if_else(pa.array(touched), new, old.cast(pa.string())) if c == text else tc.column(b, c) for c in names], names=names)

    return docs.mapInArrow(run, schema)
