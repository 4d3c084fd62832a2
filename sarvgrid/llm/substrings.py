"""Substring deduplication with a log-structured fingerprint index.

A fingerprint is the hash of a window of consecutive words. The index is a list of immutable runs; a run holds the
fingerprints of one or more batches, each hash range in a file of its own, sorted. A new batch sends its
fingerprints, packed by slices of documents, to their hash ranges; there they are merge-joined with the runs and with each
other. A match is verified by a second, independent hash, here and again in the document. The driver keeps a list of the files of
each run, and a file that is listed but can't be read whole ends the job: a lost one is never taken for an empty one. What was new becomes the next run, and when as many runs of
one level have gathered as the fan-out says, they are merged into one of the next level.

Documents of a batch get back the fingerprints that occurred earlier; their texts are then joined with those, and the words
under such windows are removed.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import discard, fresh_path, open_fs, parts, released, settle, unused
from .triejoin import _gaps, pack_arrays, slice_bytes, unpack_arrays
from .words import Words, column_bytes, release, rolling, slices, windows

WINDOW, FANOUT = 20, 2
_NULL = -(1 << 63)


def fingerprints(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, hash, check) of each window."""
    doc, start = windows(words.bounds, width)
    own = words.hashes()
    return doc, start, rolling(own, width)[start] if len(start) else own[:0], (rolling(own ^ np.uint64(0xA5A5A5A5A5A5A5A5), width, 77)[start] >> np.uint64(48)).astype(np.uint16) if len(start) else np.zeros(0, np.uint16)


def _sorted(value: np.ndarray, check: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """By hash, then check; the second key is looked at only where hashes repeat."""
    order = np.argsort(value, kind="stable")
    v, c = value[order], check[order]
    if ((v[1:] == v[:-1]) & (c[1:] != c[:-1])).any():
        order = np.lexsort((check, value))
        v, c = value[order], check[order]
    return v, c, *(x[order] for x in more)


def _edges(value: np.ndarray, check: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (check[1:] != check[:-1])])) if len(value) else np.zeros(0, np.int64)


def among(value: np.ndarray, check: np.ndarray, known_value: np.ndarray, known_check: np.ndarray) -> np.ndarray:
    """For each (value, check), if it is one of the known pairs, which are sorted by value."""
    found, at, todo = np.zeros(len(value), bool), np.searchsorted(known_value, value), np.arange(len(value))
    while len(todo):  # hashes that repeat with another check stand side by side
        todo = todo[at[todo] < len(known_value)]
        todo = todo[known_value[at[todo]] == value[todo]]
        same = known_check[at[todo]] == check[todo]
        found[todo[same]] = True
        todo = todo[~same]
        at[todo] += 1
    return found


@dataclass
class Run:
    """A sorted run: its level, its folder's name, and the bytes of its file for each hash range that has one."""

    level: int
    name: str
    files: dict[int, int]


MARK = "index-id"


@dataclass
class Index:
    """Runs of fingerprints in a folder that all executors share, in the order they were added.

    ``create`` leaves a file with an id there. A task that doesn't find it there looks at another folder of that name than the driver,
    and stops.
    """

    spark: SparkSession
    folder: str
    buckets: int
    width: int = WINDOW
    fanout: int = FANOUT
    runs: list[Run] = field(default_factory=list)
    made: int = 0
    id: str = ""
    latest: str = ""

    @classmethod
    def create(cls, spark: SparkSession, folder: str | None = None, width: int = WINDOW, fanout: int = FANOUT, buckets: int | None = None) -> Index:
        own = cls(spark, folder or fresh_path(spark, "fingerprints"), buckets or parts(spark), width, fanout, id=uuid.uuid4().hex)
        fs, base = open_fs(own.folder)
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/{MARK}") as out:
            out.write(own.id.encode())
        return own

    def _listed(self, level: int, name: str) -> Run:
        """A run whose files are all written."""
        fs, base = open_fs(self.folder)
        found = fs.get_file_info(pafs.FileSelector(f"{base}/{name}", allow_not_found=True))
        self.made += 1
        return Run(level, name, {int(f.base_name.removesuffix(".run")): f.size for f in found if f.base_name.endswith(".run")})

    def match(self, docs: DataFrame, keep: bool = True) -> DataFrame:
        """(doc_id, seen): packed hashes of the windows of each document of a new batch that occur in the index or in the batch
        under a smaller doc_id, a null one being the smallest. ``keep``: the batch becomes a run."""
        width, buckets, folder, own_id, runs = self.width, self.buckets, self.folder, self.id, self.runs
        new = f"run-{self.made:05d}"
        fs, base = open_fs(folder)
        if keep:
            fs.create_dir(f"{base}/{new}", recursive=True)

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            task, ordinal = TaskContext.get().partitionId(), 0
            for part in slices(batches, "text", slice_bytes(buckets)):
                ids = part.column("doc_id").fill_null(_NULL).to_numpy(zero_copy_only=False)
                part, ids = part.take(pa.array(np.argsort(ids, kind="stable"))), np.sort(ids)
                doc, _, value, check = fingerprints(Words(part.column("text")), width)
                key = xxhash.xxh3_64_intdigest(struct.pack("<qq", task, ordinal) + ids.tobytes()) >> 1
                ordinal += 1
                value, check, doc = _sorted(value, check, doc)  # stable: the smallest document comes first
                edge = _edges(value, check)
                first = np.repeat(ids[doc[edge]], np.diff(np.append(edge, len(value)))) if len(edge) else ids[:0]
                later = ids[doc] > first
                rows = [(key % buckets, key, 1, pack_arrays(ids, value[later], check[later], doc[later].astype(np.uint32)))]
                value, check, doc = value[edge], check[edge], doc[edge].astype(np.uint32)
                cut = np.searchsorted((value >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))
                for b in range(buckets):
                    a, z = cut[b], cut[b + 1]
                    if z > a:
                        used, who = np.unique(doc[a:z], return_inverse=True)
                        rows.append((b, key, 0, pack_arrays(_gaps(value[a:z]), check[a:z], who.astype(np.uint32 if len(used) > 65535 else np.uint16), used, ids[used])))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "slice", "kind", "payload"])

        def merge(key: tuple, table: pa.Table) -> pa.Table:
            release()
            bucket = key[0].as_py()
            rows = list(zip(*(table.column(c).to_pylist() for c in ("slice", "kind", "payload")), strict=True))
            out = [(s, 1, p) for s, k, p in rows if k == 1]
            sent = [(s, *unpack_arrays(p)) for s, k, p in rows if k == 0]
            fs, base = shared_index(folder, own_id)
            value, check = np.zeros(0, np.uint64), np.zeros(0, np.uint16)
            if sent:
                value, check, who, doc_id, of = _sorted(np.concatenate([np.cumsum(x[1], dtype=np.uint64) for x in sent]), np.concatenate([x[2] for x in sent]), np.concatenate([x[4][x[3]] for x in sent]), np.concatenate([x[5][x[3]] for x in sent]), np.repeat(np.arange(len(sent)), [len(x[1]) for x in sent]))
                edge = _edges(value, check)
                times = np.diff(np.append(edge, len(value)))
                earlier = doc_id > np.repeat(np.minimum.reduceat(doc_id, edge), times)
                old = np.zeros(len(edge), bool)
                for run in runs:  # one run at a time
                    old |= among(value[edge], check[edge], *read_run(fs, base, run, bucket))
                seen = earlier | np.repeat(old, times)
                place = np.flatnonzero(seen)
                place = place[np.argsort(of[place], kind="stable")]
                cut = np.searchsorted(of[place], np.arange(len(sent) + 1))
                for k, x in enumerate(sent):
                    mine = place[cut[k] : cut[k + 1]]
                    if len(mine):
                        out.append((x[0], 0, pack_arrays(_gaps(value[mine]), check[mine], who[mine].astype(np.uint32))))
                value, check = value[edge][~old], check[edge][~old]
            if keep:
                write_run(fs, f"{base}/{new}/{bucket:05d}.run", value, check)
            return pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], names=["slice", "kind", "payload"])

        def deal(table: pa.Table) -> pa.Table:
            release()
            ids = None
            value, check, who = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint16)], [np.zeros(0, np.uint32)]
            for kind, payload in zip(table.column("kind").to_pylist(), table.column("payload").to_pylist(), strict=True):
                got = unpack_arrays(payload)
                if kind == 1:
                    ids, *got = got
                else:
                    got[0] = np.cumsum(got[0], dtype=np.uint64)
                for to, x in zip((value, check, who), got, strict=True):
                    to.append(x)
            value, check, who = np.concatenate(value), np.concatenate(check), np.concatenate(who)
            order = np.lexsort((value, who))
            value, check, who = value[order], check[order], who[order]
            docs, at = np.unique(who, return_index=True)
            cut = np.append(at, len(who))
            seen = [value[a:b].tobytes() + check[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            return pa.table([pa.array(ids[docs]), pa.array(seen, pa.binary())], names=["doc_id", "seen"])

        # every bucket that fingerprints were sent to writes its part of the run, with or without new ones
        sent = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(send, "bucket int, slice long, kind int, payload binary")
        merged = sent.groupBy("bucket").applyInArrow(merge, "slice long, kind int, payload binary")
        dealt, self.latest = settle(merged.groupBy("slice").applyInArrow(deal, "doc_id long, seen binary"), "seen")
        if keep:
            self.runs.append(self._listed(0, new))
            self.compact()
        return dealt

    def compact(self) -> None:
        """Merges the latest runs while as many as the fan-out are of one level; old files go when the new ones are whole."""
        while len(self.runs) >= self.fanout and len({run.level for run in self.runs[-self.fanout :]}) == 1:
            old, new, folder, own_id = self.runs[-self.fanout :], f"run-{self.made:05d}", self.folder, self.id
            fs, base = open_fs(folder)
            fs.create_dir(f"{base}/{new}", recursive=True)

            def merge(batches: Iterator[pa.RecordBatch], old: list[Run] = old, new: str = new, folder: str = folder, own_id: str = own_id) -> Iterator[pa.RecordBatch]:
                fs, base = shared_index(folder, own_id)
                for batch in batches:
                    for bucket in batch.column("id").to_pylist():
                        if any(bucket in run.files for run in old):
                            got = [read_run(fs, base, run, bucket) for run in old]
                            value, check = _sorted(np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got]))
                            edge = _edges(value, check)
                            write_run(fs, f"{base}/{new}/{bucket:05d}.run", value[edge], check[edge])
                    yield batch

            self.spark.range(0, self.buckets, 1, self.buckets).mapInArrow(merge, "id long").count()
            run = self._listed(old[-1].level + 1, new)
            if run.files.keys() != set().union(*(x.files for x in old)):
                raise FileNotFoundError(f"the merged run {base}/{new} lacks hash ranges of those it replaces")
            self.runs[-self.fanout :] = [run]
            for x in old:
                fs.delete_dir(f"{base}/{x.name}")

    def drop(self) -> None:
        discard(self.spark, self.folder)


def write_run(fs, path: str, value: np.ndarray, check: np.ndarray) -> None:
    """Under a name of its own, then renamed: a task that runs again or twice leaves one whole file."""
    from pyspark import TaskContext

    draft = f"{path}.{TaskContext.get().taskAttemptId()}"
    with fs.open_output_stream(draft) as out:
        out.write(pack_arrays(_gaps(value), check))
    fs.move(draft, path)


def shared_index(folder: str, own_id: str) -> tuple[pafs.FileSystem, str]:
    """open_fs(), once sure that the folder is the one that the driver sees."""
    fs, base = open_fs(folder)
    try:
        with fs.open_input_file(f"{base}/{MARK}") as source:
            there = source.read().decode()
    except FileNotFoundError:
        there = ""
    if there != own_id:
        raise FileNotFoundError(f"{folder} isn't shared by all executors and the driver: the index can't be kept there")
    return fs, base


def read_run(fs: pafs.FileSystem, base: str, run: Run, bucket: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, checks) of one hash range of a run. Only a range that has no file by the run's own list is empty."""
    if bucket not in run.files:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint16)
    with fs.open_input_file(f"{base}/{run.name}/{bucket:05d}.run") as source:
        data = source.read()
    if len(data) != run.files[bucket]:
        raise OSError(f"{base}/{run.name}/{bucket:05d}.run has {len(data)} bytes of {run.files[bucket]}")
    gaps, check = unpack_arrays(data)
    return np.cumsum(gaps, dtype=np.uint64), check


def removed_words(words: Words, seen: list[bytes | None], width: int) -> np.ndarray:
    """For each word, if it lies under a window that is in its document's ``seen`` or earlier in its document."""
    doc, start, value, check = fingerprints(words, width)
    gone = np.zeros(len(value), bool)
    cut = np.searchsorted(doc, np.arange(words.n + 1))
    for d, x in enumerate(seen):
        if x:
            a, b = cut[d], cut[d + 1]
            n = len(x) // 10
            gone[a:b] = among(value[a:b], check[a:b], np.frombuffer(x, np.uint64, n), np.frombuffer(x, np.uint16, n, 8 * n))
    # repeats inside a document: all but the first
    order = np.lexsort((value, doc))
    same = (doc[order[1:]] == doc[order[:-1]]) & (value[order[1:]] == value[order[:-1]]) & (check[order[1:]] == check[order[:-1]])
    gone[order[1:][same]] = True
    cover = np.zeros(len(words.ids) + 1, np.int64)
    np.add.at(cover, start[gone], 1)
    np.add.at(cover, start[gone] + width, -1)
    return np.cumsum(cover)[:-1] > 0


def batch_bounds(docs: DataFrame, n: int) -> list[int]:
    """doc_ids that cut ``docs`` into about ``n`` batches of equal numbers of rows."""
    if n < 2:
        return []
    found = docs.select(F.col("doc_id").cast("long").alias("d")).where("d is not null").stat.approxQuantile("d", [k / n for k in range(1, n)], 0.01)
    return sorted({int(x) for x in found})


def deduplicate(docs: DataFrame, width: int = WINDOW, batches: int = 3, index: Index | None = None, rows: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each document (doc_id, text; other columns are ignored). With ``rows``, the
    rows of ``docs`` instead, all columns as they are but for the text (kept words joined by one space where any
    went, else untouched) and n_chars, where there is one.

    A word goes if it lies under a window of ``width`` words that also starts earlier: under a smaller doc_id, or earlier in
    its own text. Batches are ranges of doc_id in ascending order. With an ``index`` of earlier calls, what it holds
    is earlier than all. A null, empty or blank text has no words; one shorter than a window loses none. Rows that share a
    doc_id don't count as earlier than each other, and each repeats its result; a null doc_id is the smallest. An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    own = index or Index.create(spark, width=width)
    doc_id = F.col("doc_id").cast("long")
    bounds = batch_bounds(docs, batches)
    seen_id, seen_column = unused(docs, "seen_id"), unused(docs, "seen")
    found = []
    for k in range(len(bounds) + 1):
        some = docs
        if k:
            some = some.where(doc_id > bounds[k - 1])
        if k < len(bounds):
            some = some.where((doc_id <= bounds[k]) | doc_id.isNull() if k == 0 else doc_id <= bounds[k])
        # an index of our own has no reader after the last batch
        seen = own.match(some, keep=index is not None or k < len(bounds))
        seen = seen.groupBy("doc_id").agg(F.collect_set("seen").alias(seen_column)).select(F.when(F.col("doc_id") != _NULL, F.col("doc_id")).alias(seen_id), seen_column)
        pruned, _ = settle((prune_rows if rows else prune)(some, seen, own.width), "pruned")
        discard(spark, own.latest)
        found.append(pruned)
    if index is None:
        own.drop()
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _seen_lists(column: pa.Array) -> list[bytes | None]:
    """For each document, its packed hashes. Rows that share a doc_id may have come in several slices."""

    def whole(parts: list[bytes]) -> bytes:
        value = np.concatenate([np.frombuffer(x, np.uint64, len(x) // 10) for x in parts])
        check = np.concatenate([np.frombuffer(x, np.uint16, len(x) // 10, len(x) // 10 * 8) for x in parts])
        value, check = _sorted(value, check)
        return value.tobytes() + check.tobytes()

    return [None if not x else x[0] if len(x) == 1 else whole(x) for x in column.to_pylist()]


def _kept(words: Words, gone: np.ndarray, d: int) -> bytes:
    a, b = words.bounds[d], words.bounds[d + 1]
    return b" ".join(map(words.vocabulary.__getitem__, words.ids[a:b][~gone[a:b]].tolist()))


def _removed(words: Words, gone: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(gone)])[words.bounds])


def prune(docs: DataFrame, seen: DataFrame, width: int) -> DataFrame:
    """The digest of ``docs`` without words under windows of ``seen`` (an id, packed hashes) or repeated in their text."""
    seen_id, seen_column = seen.columns
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(seen, rows["doc_id"].eqNullSafe(seen[seen_id]), "left").drop(seen_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = Words(part.column("text"))
            gone = removed_words(words, _seen_lists(part.column(seen_column)), width)
            kept = [hashlib.sha256(_kept(words, gone, d)).hexdigest() for d in range(words.n)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words.lengths), pa.array(_removed(words, gone)), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def prune_rows(docs: DataFrame, seen: DataFrame, width: int) -> DataFrame:
    """prune(), with the rows of ``docs`` in place of their digest."""
    seen_id, seen_column = seen.columns
    rows = docs.join(seen, docs["doc_id"].cast("long").eqNullSafe(seen[seen_id]), "left").drop(seen_id)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            text = part.column("text")
            words = Words(text)
            gone = removed_words(words, _seen_lists(part.column(seen_column)), width)
            fewer = _removed(words, gone) > 0
            new = [_kept(words, gone, d) if fewer[d] else t for d, t in enumerate(column_bytes(text))]
            new = pa.array(new, pa.binary()).cast(pa.string())
            columns = {n: part.column(n) for n in names} | {"text": new}
            if "n_chars" in names:
                had = columns["n_chars"]
                columns["n_chars"] = pa.compute.if_else(pa.array(fewer), pa.compute.utf8_length(new).cast(had.type), had)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return rows.mapInArrow(run, docs.schema)
