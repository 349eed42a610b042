"""Language-model scoring of documents.

Two models are learned from the documents whose crc32(id) mod `folds` is not 0.
The base is a smoothed unigram over words.  Its counts cover every training word:
each task sends the distinct words of a unit (a slice of about 4 MB of text; 8-byte
hashes) with their counts to buckets of hashes, buckets add them up, and the totals go
back to the units, so neither a table of all words nor the texts are moved.  The
other is a causal self-attention model over subword ids.  Its id counts, its id classes
and its training cover every training document; its first fit is on about
`start_windows` windows drawn from every unit in proportion, after which tasks train in
parallel on all windows and their weights are averaged.

The documents are read, split into words and encoded once: each unit's ids and word
numbers are a file in the shared folder, which training and scoring read.

Cases: a null or empty text is its end token; a null id keeps its row, is not held
out and is not learned from; repeated rows count each; a text of any length is whole in
its unit; documents of equal scores need no order; with no training document all
counts are 0 and the scores those of uniform classes; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import attention as at
from graphloom.llm import bpe
from graphloom.llm import textcore as tc
from graphloom.llm.places import packed, unpacked
from graphloom.llm.shared import input_bytes, located, map_arrow, read_bytes, remainder, shared_dir, write_bytes, written
from graphloom.llm.toxicity import _LOWER

FOLDS = 10
END = np.uint64(0x1D8E4E27C47D124F)  # stands for the end of a document among words
SLICE = 4 << 20
UNITS = 8  # to a task, and more where that would be over MOST tasks
MOST = 20000


@dataclass(frozen=True)
class Ids:
    """The ids that begin and end a document, and how many ids there are."""

    begin: int
    end: int
    size: int

    @classmethod
    def of(cls, enc: bpe.Encoder) -> Ids:
        """The vocabulary's own marks, or new ids behind it."""
        begin, end = enc.special.get("<|startoftext|>", enc.size), enc.special.get("<|endoftext|>", enc.size + 1)
        return cls(begin, end, max(enc.size, begin + 1, end + 1))


def _units(rows: DataFrame, path: str, buckets: int, folder: str) -> DataFrame:
    """Writes the units' files; returns unit, bucket, and the bucket's distinct words of the unit with their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = bpe.encoder(path), TaskContext.get().partitionId()
        kind = np.uint16 if Ids.of(enc).size < 1 << 16 else np.uint32
        for number, (b, buf, off) in enumerate(tc.slices(batches, limit=SLICE)):
            unit = f"{folder}/{part:06d}-{number:06d}"  # a task that runs again replaces its files by equal ones
            low = _LOWER[buf]
            starts, ends, wo = tc.spans(low, off)
            fold, ids = tc.int64(b, "fold"), tc.column(b, "doc_id").cast(pa.int64())
            learn = fold > 0
            h, word = np.unique(np.append(tc.span_hashes(low, starts, ends), END), return_inverse=True)
            c = np.bincount(word, np.append(np.repeat(learn, np.diff(wo)).astype(float), float(learn.sum())), len(h)).astype("<u4")
            own, to = enc.encode(buf, off)
            windows = int((-(-(np.diff(to)[learn] + 1) // at.WINDOW)).sum())
            write_bytes(unit, packed(doc=ids.fill_null(0).to_numpy(zero_copy_only=False), known=ids.is_valid().to_numpy(zero_copy_only=False), fold=fold, ids=own.astype(kind), to=to, word=word.astype(np.uint32), wo=wo))
            bucket = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            cut = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
            cells = list(zip(cut, [*cut[1:], len(h)], strict=True))
            yield pa.record_batch([pa.array([unit] * len(cut)), pa.array([windows] * len(cut), pa.int64()), pa.array(bucket[cut]), pa.array([h[i:j].tobytes() for i, j in cells], pa.binary()), pa.array([c[i:j].tobytes() for i, j in cells], pa.binary())], names=["unit", "windows", "bucket", "words", "counts"])

    return map_arrow(rows, run, "unit string, windows long, bucket long, words binary, counts binary")


def _prepare(rows: DataFrame, path: str, total_bytes: int) -> DataFrame:
    """One row per unit: unit, windows (to train on), and its buckets' share of n (training words) and v (distinct ones).  The words' totals lie beside the unit's file."""
    buckets = max(1, total_bytes // (24 << 20))

    def add(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        words = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["words"]]
        h, inverse = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in t["counts"]]), len(h)).astype("<i8")
        cut = np.cumsum([0, *map(len, words)])
        back = [total[inverse[a:b]].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        once = lambda x: pa.array([int(x), *[0] * (len(words) - 1)], pa.int64())
        return pa.table([t["unit"], t["windows"], t["bucket"], pa.array(back, pa.binary()), once(total.sum()), once((total > 0).sum())], names=["unit", "windows", "bucket", "counts", "n", "v"])

    def store(table: pa.Table) -> pa.Table:
        t = table.sort_by("bucket").combine_chunks()
        unit = t["unit"][0].as_py()
        write_bytes(unit + ".counts", packed(counts=np.concatenate([np.frombuffer(x.as_buffer(), "<i8") for x in t["counts"]])))
        return pa.table([[unit], t["windows"][:1], pa.array([sum(t["n"].to_pylist())], pa.int64()), pa.array([sum(t["v"].to_pylist())], pa.int64())], names=["unit", "windows", "n", "v"])

    sent = _units(rows, path, buckets, shared_dir(rows.sparkSession) + "/units").groupBy("bucket").applyInArrow(add, "unit string, windows long, bucket long, counts binary, n long, v long")
    return written(sent.groupBy("unit").applyInArrow(store, "unit string, windows long, n long, v long"))


def _tree(df: DataFrame, combine, column: str) -> bytes | None:
    """Reduces binary rows (task, n, data) in groups of 16 until one is left."""
    while (n := df.count()) > 1:
        groups = -(-n // 16)
        df = written(df.withColumn("task", F.pmod("task", F.lit(groups))).groupBy("task").applyInArrow(combine, df.schema))
        if groups == 1:
            break
    row = df.first()
    return bytes(row[column]) if row else None


def _training(u: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a unit's training documents, and where each begins."""
    n, learn = np.diff(u["to"]), np.flatnonzero(u["fold"] > 0)
    return u["ids"][tc.ragged(u["to"][:-1][learn], n[learn])], np.concatenate([[0], np.cumsum(n[learn])])


def _statistics(spread: DataFrame, ids: Ids, windows: int, start_windows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Training counts of all ids, their contexts, and windows of every unit, about start_windows in proportion."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((ids.size, 1 + 2 * at.MARKS), np.int64)
        some = []
        for b in batches:
            for unit in tc.column(b, "unit").to_pylist():
                own, to = _training(unpacked(read_bytes(unit)))
                total[:, 0] += np.bincount(own, minlength=ids.size)
                total[ids.end, 0] += len(to) - 1
                total[:, 1:] += at.contexts(own, to, ids.size)
                w = at.windows_of(own, to, ids.begin, ids.end)
                rng = np.random.default_rng(int(own[:64].astype(np.int64).sum()) + len(own))
                take = min(len(w), int(len(w) * start_windows / max(1, windows) + rng.random()))
                some.append(w[np.sort(rng.permutation(len(w))[:take])])
        if some:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([np.concatenate(some).astype("<u4").tobytes()], pa.binary()), pa.array([packed(total=total)], pa.binary())], names=["task", "windows", "data"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(unpacked(x.as_py())["total"] for x in t["data"])
        return pa.table([t["task"][:1], pa.array([packed(total=total)], pa.binary())], names=["task", "data"])

    found = written(map_arrow(spread, run, "task long, windows binary, data binary"))
    first = b"".join(bytes(r["windows"]) for r in found.select("task", "windows").orderBy("task").toLocalIterator())  # about start_windows
    raw = _tree(found.select("task", "data"), add, "data")
    total = unpacked(raw)["total"] if raw else np.zeros((ids.size, 1 + 2 * at.MARKS), np.int64)
    return total[:, 0], total[:, 1:], np.frombuffer(first, "<u4").reshape(-1, at.WINDOW + 1)


def _learn(spread: DataFrame, ids: Ids, windows: int, rounds: int, start_windows: int) -> tuple[at.Model, np.ndarray, np.ndarray]:
    """The model, each id's class, and the log of its share of its class."""
    counts, ctx, first = _statistics(spread, ids, windows, start_windows)
    classes = at.cluster(ctx, counts)
    mass = np.bincount(classes, counts + 0.1)
    inside = (np.log(counts + 0.1) - np.log(mass[classes])).astype(np.float64)
    model = at.Model.start(ids.size, np.maximum(mass / mass.sum(), 1e-12))
    at.train(model, first, classes, ids.end, epochs=4)
    for k in range(rounds):
        now = spread.sparkSession.sparkContext.broadcast((model.pack(), classes))  # one model: of fixed size

        def local(batches: Iterator[pa.RecordBatch], now=now, k=k, model=model) -> Iterator[pa.RecordBatch]:
            m, rng, n = model.unpack(now.value[0]), np.random.default_rng(k), 0
            t = at.Trainer(m, now.value[1], 0.03 / (k + 1), ids.end)
            for b in batches:
                for unit in tc.column(b, "unit").to_pylist():
                    w = at.windows_of(*_training(unpacked(read_bytes(unit))), ids.begin, ids.end)
                    t.all(w[rng.permutation(len(w))])
                    n += len(w)
            if n:
                yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([float(n)]), pa.array([m.pack()], pa.binary())], names=["task", "n", "data"])

        def mean(t: pa.Table) -> pa.Table:
            n = t["n"].to_numpy()
            total = sum(np.frombuffer(x.as_buffer(), np.float32) * np.float32(w / n.sum()) for x, w in zip(t["data"], n, strict=True))
            return pa.table([t["task"][:1], pa.array([float(n.sum())]), pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["task", "n", "data"])

        new = _tree(written(map_arrow(spread, local, "task long, n double, data binary")), mean, "data")
        if new:
            model = model.unpack(new)
    return model, classes, inside


def score(docs: DataFrame, path: str, folds: int = FOLDS, rounds: int = 1, start_windows: int = 8192, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    rows = located(docs).select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))  # from files, so that their size is known
    units = _prepare(rows.withColumn("fold", remainder("doc_id", folds)), path, input_bytes(rows))
    n_units, n, v, windows = (x or 0 for x in units.agg(F.count("*"), F.sum("n"), F.sum("v"), F.sum("windows")).first())
    spread = units.select("unit").repartition(max(1, min(-(-n_units // UNITS), MOST)))
    ids = Ids.of(bpe.encoder(path))
    sent = docs.sparkSession.sparkContext.broadcast(_learn(spread, ids, windows, rounds, start_windows))  # one model: of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, classes, inside = sent.value
        down = np.log10(n + 0.1 * (v + 1))
        for unit in (x for b in batches for x in tc.column(b, "unit").to_pylist()):
            u, counts = unpacked(read_bytes(unit)), unpacked(read_bytes(unit + ".counts"))["counts"]
            word, docs_ = u["word"], len(u["doc"])
            each, known = (np.log10(counts + 0.1) - down)[word], counts[word] > 0
            doc_of = np.repeat(np.arange(docs_), np.diff(u["wo"]))
            unigram = np.bincount(doc_of, each[:-1], docs_) + each[-1]
            n_known = np.bincount(doc_of, known[:-1], docs_).astype(np.int64) + int(known[-1])
            seq = np.insert(u["ids"].astype(np.int64), u["to"][:-1], ids.begin)
            lm = at.score(model, classes, inside, seq, u["to"] + np.arange(docs_ + 1), ids.end)
            yield pa.record_batch(
                [pa.array(u["doc"], mask=~u["known"]), pa.array(u["fold"] == 0), pa.array(np.diff(u["wo"]) + 1), pa.array(n_known), pa.array(np.full(docs_, n, np.int64)), pa.array(unigram), pa.array(lm)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return map_arrow(spread, run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
