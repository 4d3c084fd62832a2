"""N-gram Jaccard join with a prefix tree.

A document's set is its distinct word shingles. Texts with equal sets are one class, and classes are joined:

1. Shingles are counted over all documents. Slices of documents send their distinct shingle hashes, packed, to the hash range
   they fall into, and get back those that occur elsewhere with their counts. A shingle of one document alone can't be
   shared: it only counts towards the size of the set.
2. The global order is rarest first. Two sets that link share a shingle among the first (size - least overlap + 1) of each.
   Most documents have only shingles of their own there and are done.
3. The rest meet by those shingles. Groups are the components of (document, smallest of its shingle): the rare order keeps
   them near the real ones. Large groups are split into blocks, and each pair of blocks is a task of bounded size.
4. In a task the sets, commonest shingle first, are stored in a trie. Each set goes down it level by level: overlap
   found on a path is shared by all sets below, and a subtree ends as soon as what remains of either side can't reach the
   least overlap that its sizes need.

All links are found, so both the component and the number of links of a document are exact, up to collisions of 64-bit hashes of
shingles, of 128-bit hashes of sets, and in steps 3 and 4, where sets go by half of theirs, of 64-bit ones.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .store import discard, parts, settle, unused
from .words import Words, release, shingle_sets, slices

#: Bytes of text in the smallest slice whose shingles are counted together, and sets in a block of a group.
SLICE, BLOCK = 4 << 20, 4096
_MANY = np.uint32(0xFFFFFFFF)


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays as one binary: byte planes of each, compressed together."""
    head = struct.pack("<B", len(arrays)) + b"".join(struct.pack("<2sQ", x.dtype.str[1:].encode(), len(x)) for x in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes() for x in arrays))


def unpack_arrays(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, at, out = raw[0], 1, []
    heads = [struct.unpack_from("<2sQ", raw, at + 10 * k) for k in range(n)]
    at += 10 * n
    for kind, size in heads:
        dtype = np.dtype("<" + kind.decode())
        planes = np.frombuffer(raw, np.uint8, size * dtype.itemsize, at).reshape(dtype.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(dtype) if size else np.zeros(0, dtype))
        at += size * dtype.itemsize
    return out


def slice_bytes(buckets: int) -> int:
    """Bytes of text in a slice. More hash ranges take larger slices, within a worker's memory, so that what a slice sends to
    a range stays worth a row."""
    return min(max(SLICE, buckets * (8 << 10)), 32 << 20)


def _gaps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=np.uint64(0))


def shared_shingles(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """A row for each document: doc_id, n (size of the set), h1, h2 (its hash), prefix (shared shingles among the
    first of the global order) and, where there are such, shared (all its shared shingles, packed)."""
    buckets = parts(docs.sparkSession)
    flow = "bucket int, slice long, kind int, payload binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, ordinal = TaskContext.get().partitionId(), 0
        for part in slices(batches, "text", slice_bytes(buckets)):
            values, bounds = shingle_sets(Words(part.column("text"), lower=True), width)
            doc_ids = part.column("doc_id")
            n = np.diff(bounds)
            digests = [xxhash.xxh3_128_digest(values[a:b].tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            h = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
            key = xxhash.xxh3_64_intdigest(struct.pack("<qq", task, ordinal) + h.tobytes()) >> 1
            ordinal += 1
            doc = np.repeat(np.arange(len(n), dtype=np.uint32), n)
            order = np.argsort(values, kind="stable")
            values, doc = values[order], doc[order]
            edge = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, int)
            times = np.diff(np.append(edge, len(values)))
            many = np.repeat(times > 1, times)
            own = pack_arrays(np.array(doc_ids.fill_null(0), np.int64), np.array(doc_ids.is_null()).astype(np.uint8), n.astype(np.int64), h[:, 0], h[:, 1], _gaps(values[many]), doc[many])
            who = np.where(times > 1, _MANY, doc[edge]) if len(edge) else np.zeros(0, np.uint32)
            low = values[edge]
            cut = np.searchsorted((low >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))
            rows = [(key % buckets, key, 1, own)]
            for b in range(buckets):
                a, z = cut[b], cut[b + 1]
                if z > a:
                    t = times[a:z]
                    rows.append((b, key, 0, pack_arrays(_gaps(low[a:z]), who[a:z].astype(np.uint32), t[t > 1].astype(np.uint32))))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "slice", "kind", "payload"])

    def count(table: pa.Table) -> pa.Table:
        release()
        rows = [(s, k, p) for s, k, p in zip(*(table.column(c).to_pylist() for c in ("slice", "kind", "payload")), strict=True)]
        out = [(s, 1, p) for s, k, p in rows if k == 1]
        sent = [(s, *unpack_arrays(p)) for s, k, p in rows if k == 0]
        if sent:
            value = np.concatenate([np.cumsum(x[1], dtype=np.uint64) for x in sent])
            who = np.concatenate([x[2] for x in sent])
            of = np.repeat(np.arange(len(sent)), [len(x[1]) for x in sent])
            weight = np.ones(len(value), np.int64)
            weight[who == _MANY] = np.concatenate([x[3] for x in sent])
            order = np.argsort(value, kind="stable")
            value, who, of, weight = value[order], who[order], of[order], weight[order]
            edge = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
            df = np.repeat(np.add.reduceat(weight, edge), np.diff(np.append(edge, len(value))))
            keep = df > 1
            value, who, of, df = value[keep], who[keep], of[keep], np.minimum(df[keep], 0xFFFFFFFF).astype(np.uint32)
            order = np.argsort(of, kind="stable")
            cut = np.searchsorted(of[order], np.arange(len(sent) + 1))
            for k, x in enumerate(sent):
                mine = order[cut[k] : cut[k + 1]]
                if len(mine):
                    out.append((x[0], 0, pack_arrays(_gaps(value[mine]), who[mine], df[mine])))
        return pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], names=["slice", "kind", "payload"])

    def settle_sets(table: pa.Table) -> pa.Table:
        release()
        own, replies = None, []
        for kind, payload in zip(table.column("kind").to_pylist(), table.column("payload").to_pylist(), strict=True):
            if kind == 1:
                own = unpack_arrays(payload)
            else:
                replies.append(unpack_arrays(payload))
        doc_ids, null, n, h1, h2, many_gaps, many_doc = own
        value = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in replies]) if replies else np.zeros(0, np.uint64)
        who = np.concatenate([x[1] for x in replies]) if replies else np.zeros(0, np.uint32)
        df = np.concatenate([x[2] for x in replies]) if replies else np.zeros(0, np.uint32)
        # shingles of several documents of this slice: the slice kept whose they are
        many = np.cumsum(many_gaps, dtype=np.uint64)
        there = who == _MANY
        order = np.argsort(value[there], kind="stable")
        known, known_df = value[there][order], df[there][order]
        at = np.searchsorted(known, many)
        value, doc, df = np.concatenate([value[~there], many]), np.concatenate([who[~there], many_doc]), np.concatenate([df[~there], known_df[at]])
        order = np.lexsort((value, df, doc))
        value, doc = value[order], doc[order]
        bounds = np.searchsorted(doc, np.arange(len(n) + 1))
        first = n - -(-percent * n // 100) + 1
        take = np.clip(first - (n - np.diff(bounds)), 0, np.diff(bounds))
        take[n == 0] = 0
        prefix, shared = [], []
        for a, b, k in zip(bounds[:-1].tolist(), bounds[1:].tolist(), take.tolist(), strict=True):
            prefix.append(value[a : a + k].view(np.int64))
            shared.append(value[a:b].tobytes() if k else None)
        return pa.table([pa.array(doc_ids, mask=null.astype(bool)), pa.array(n), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(prefix, pa.list_(pa.int64())), pa.array(shared, pa.binary())], names=["doc_id", "n", "h1", "h2", "prefix", "shared"])

    sent = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(send, flow)
    counted = sent.groupBy("bucket").applyInArrow(count, "slice long, kind int, payload binary")
    return counted.groupBy("slice").applyInArrow(settle_sets, "doc_id long, n long, h1 long, h2 long, prefix array<long>, shared binary")


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... n places on, one after another."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _grouped(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, members): members[bounds[k]:bounds[k + 1]] are the places that hold k."""
    return np.concatenate([[0], np.cumsum(np.bincount(keys, minlength=n))]).astype(np.int64), np.argsort(keys, kind="stable")


class Trie:
    """Sets of token ids in a path-compressed prefix tree. ``sets`` are in lexicographic order; ``sizes`` are the full
    sizes, which count shingles that no other document has."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        parent, depth, owner, at = [-1], [0], [0], np.zeros(len(sets), np.int64)
        stack, before = [0], np.zeros(0, np.int64)
        for k, s in enumerate(sets):
            m = min(len(s), len(before))
            differ = np.flatnonzero(s[:m] != before[:m])
            common = int(differ[0]) if len(differ) else m
            while depth[stack[-1]] > common:
                low = stack.pop()
                if depth[stack[-1]] < common:  # the edge is cut where the two sets part
                    parent.append(stack[-1])
                    depth.append(common)
                    owner.append(owner[low])
                    parent[low] = len(parent) - 1
                    stack.append(len(parent) - 1)
            if len(s) > depth[stack[-1]]:
                parent.append(stack[-1])
                depth.append(len(s))
                owner.append(k)
                stack.append(len(parent) - 1)
            at[k], before = stack[-1], s
        self.parent, self.depth = np.array(parent), np.array(depth)
        n = len(parent)
        self.begin = np.concatenate([[0], self.depth[self.parent[1:]]])
        self.length = self.depth - self.begin
        self.start = np.cumsum(self.length) - self.length
        self.tokens = np.concatenate([sets[o][b:d] for o, b, d in zip(owner, self.begin.tolist(), depth, strict=True)]) if len(sets) else np.zeros(0, np.int64)
        self.children = _grouped(self.parent[1:], n)
        self.ends, self.sizes = _grouped(at, n), sizes
        # of the sets in each subtree: least and greatest size, last in order, deepest end
        least, most = np.full(n, 1 << 60), np.zeros(n, np.int64)
        last, deep = np.full(n, -1), self.depth.copy()
        np.minimum.at(least, at, sizes)
        np.maximum.at(most, at, sizes)
        np.maximum.at(last, at, np.arange(len(sets)))
        for v in np.argsort(-self.depth, kind="stable").tolist():
            if (u := parent[v]) >= 0:
                least[u], most[u] = min(least[u], least[v]), max(most[u], most[v])
                last[u], deep[u] = max(last[u], last[v]), max(deep[u], deep[v])
        self.least, self.most, self.last, self.below = least, most, last, deep - self.depth
        self.overlap = np.zeros(n, np.int64)

    def links(self, k: int, size: int, mask: np.ndarray, own: int, percent: int) -> np.ndarray:
        """The sets after set ``k`` that link with a set of ``size``; ``mask`` marks its ``own`` tokens."""
        (first, child), (end_at, end) = self.children, self.ends
        found, over = [], self.overlap
        now = np.zeros(1, np.int64)  # the root
        while len(now):
            kids = child[_ranges(first[now], first[now + 1] - first[now])] + 1
            if not len(kids):
                break
            # sizes that can't link, and subtrees whose sets were all searched before
            ok = (self.last[kids] > k) & (100 * self.most[kids] >= percent * size) & (100 * size >= percent * self.least[kids])
            kids = kids[ok]
            if not len(kids):
                break
            n = self.length[kids]
            hits = mask[self.tokens[_ranges(self.start[kids], n)]]
            over[kids] = over[self.parent[kids]] + np.add.reduceat(hits, np.cumsum(n) - n, dtype=np.int64)
            reach = over[kids] + np.minimum(own - over[kids], self.below[kids])
            low = np.maximum(self.least[kids], -(-percent * size // 100))
            now = kids[reach * (100 + percent) >= percent * (size + low)]
            sets = end[_ranges(end_at[now], end_at[now + 1] - end_at[now])]
            o = np.repeat(over[now], end_at[now + 1] - end_at[now])
            found.append(sets[(sets > k) & (o * (100 + percent) >= percent * (size + self.sizes[sets]))])
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def join_group(keys: list[int], sizes: np.ndarray, shared: list[bytes], copies: np.ndarray, blocks: np.ndarray, percent: int, cross: bool) -> tuple[np.ndarray, np.ndarray]:
    """(label, links) of each set of a group: the smallest key joined with it here, and the documents it links with.
    ``cross``: only links between two blocks; then the sets of one go down the trie of the other."""
    raw = [np.frombuffer(x, np.uint64) for x in shared]
    lengths = np.array([len(x) for x in raw])
    _, local, times = np.unique(np.concatenate(raw), return_inverse=True, return_counts=True)
    rank = np.empty(len(times), np.int64)
    rank[np.argsort(-times, kind="stable")] = np.arange(len(times))
    cut = np.cumsum(lengths)[:-1]
    sets = [np.sort(x) for x in np.split(rank[local], cut)]
    order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
    if cross:  # the block that is searched first
        order = sorted(order, key=lambda i: blocks[i] != blocks.max())
    sets = [sets[i] for i in order]
    keys_, sizes, copies, blocks = np.array(keys, np.int64)[order], sizes[order], copies[order], blocks[order]
    n = int((blocks == blocks.max()).sum()) if cross else len(sets)
    trie, mask = Trie(sets[:n], sizes[:n]), np.zeros(len(times), bool)
    label, links = np.arange(len(sets)), np.zeros(len(sets), np.int64)
    for k in range(n if cross else 0, len(sets)):
        mask[sets[k]] = True
        found = trie.links(-1 if cross else k, int(sizes[k]), mask, len(sets[k]), percent)
        mask[sets[k]] = False
        if len(found):
            links[k] += copies[found].sum()
            links[found] += copies[k]
            met = np.unique(np.append(label[found], label[k]))
            if len(met) > 1:
                label[np.isin(label, met)] = met[0]
    out_label, out_links = np.empty(len(sets), np.int64), np.empty(len(sets), np.int64)
    least = np.full(len(sets), np.iinfo(np.int64).max)
    np.minimum.at(least, label, keys_)
    out_label[order], out_links[order] = least[label], links
    return out_label, out_links


def jaccard_classes(docs: DataFrame, width: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of each document (doc_id, text; other columns are ignored).

    Documents link when 100 * intersection >= percent * union of their sets of ``width``-word shingles, words lower-cased in A-Z.
    component_id is the smallest doc_id reachable by links; n_links is the number of other rows linked directly, rows of equal
    sets included. A text of fewer words is one shingle. A null, empty or blank text has the empty set and links with nothing:
    its component is itself. Rows that repeat a doc_id are rows like others; a null doc_id never names a component unless all of it
    is null. An empty table gives no rows. Whole texts count, of any length; sets of equal order and size are taken in any.
    """
    spark = docs.sparkSession
    sets, _ = settle(shared_shingles(docs, width, percent), "sets")
    some = sets.where("n > 0")
    classes = some.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    near = some.where(F.size("prefix") > 0).select("h1", "h2", "n", "prefix", "shared").dropDuplicates(["h1", "h2"])
    near, near_path = settle(near.join(classes.select("h1", "h2", "copies"), ["h1", "h2"]), "near")
    postings = near.select("h1", F.explode("prefix").alias("token"))
    pivots = postings.groupBy("token").agg(F.min("h1").alias("pivot"), F.count("*").alias("c")).where("c > 1").select("token", "pivot")
    met = postings.join(pivots, "token").where("h1 <> pivot").select(F.col("h1").alias("a"), F.col("pivot").alias("b"))
    groups = components(met).withColumnRenamed("node", "h1")
    groups, groups_path = settle(groups, "groups")
    counts = groups.groupBy("root").agg(F.count("*").alias("size"))
    grouped = groups.join(counts, "root").join(near.drop("prefix"), "h1")
    n_blocks = F.ceil(F.col("size") / F.lit(block)).cast("int")
    grouped = grouped.withColumn("blocks", n_blocks).withColumn("own", F.pmod(F.xxhash64("h1"), F.col("blocks")).cast("int"))
    grouped = grouped.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    grouped = grouped.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))

    def join(key: tuple, table: pa.Table) -> pa.Table:
        cross = key[1].as_py() != key[2].as_py()
        h1 = table.column("h1").to_pylist()
        label, links = join_group(h1, table.column("n").to_numpy(), table.column("shared").to_pylist(), table.column("copies").to_numpy(), table.column("own").to_numpy(), percent, cross)
        return pa.table([table.column("h1"), table.column("h2"), pa.array(label), pa.array(links)], names=["h1", "h2", "label", "links"])

    joined = grouped.select("root", "low", "high", "h1", "h2", "n", "copies", "own", "shared").groupBy("root", "low", "high").applyInArrow(join, "h1 long, h2 long, label long, links long")
    joined, joined_path = settle(joined, "joined")
    if counts.where(F.col("size") > block).limit(1).count():  # a group in blocks: what each pair of blocks joined is joined
        roots = components(joined.select(F.col("h1").alias("a"), F.col("label").alias("b"))).select(F.col("node").alias("h1"), F.col("root").alias("label"))
        joined = joined.groupBy("h1", "h2").agg(F.sum("links").alias("links")).join(roots, "h1", "left").select("h1", "h2", F.coalesce("label", "h1").alias("label"), "links")
    labelled = joined.join(classes, ["h1", "h2"])
    least = labelled.groupBy("label").agg(F.min("least").alias("component"))
    found = labelled.join(least, "label").select("h1", "h2", "component", "links")
    classes = classes.join(found, ["h1", "h2"], "left").select("h1", "h2", F.coalesce("component", "least").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    # only texts that link with another are looked up; read from a table, so that Spark can split the rows of a common one
    classes, _ = settle(classes.where("links > 0"), "classes")
    discard(spark, near_path, groups_path, joined_path)
    linked = sets.where("n > 0").select("doc_id", "n", "h1", "h2").join(classes, ["h1", "h2"], "left")
    linked = linked.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("links").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))
    return linked.unionByName(sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stand for their component: the one of smallest doc_id. Columns stay as they are, of whatever names.

    Of rows that share a doc_id the first by text stays, then by the other columns that can be ordered; rows alike in all of them
    are one. Rows with a null doc_id can't be told apart by it and all stay. Null, empty and blank texts link with nothing, so
    each stays; texts count whole; an empty table gives no rows.
    """
    found = jaccard_classes(docs, width, percent)
    key, place = unused(docs, "keep"), unused(docs, "place")
    keep = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(key)).distinct()
    same = docs.join(keep, docs["doc_id"].cast("long") == keep[key])
    others = [docs[f.name] for f in docs.schema if f.name not in ("doc_id", "text") and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    first = Window.partitionBy(key).orderBy(docs["text"], *others)
    once = same.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).drop(key, place)
    return once.unionByName(docs.where(docs["doc_id"].isNull()))
