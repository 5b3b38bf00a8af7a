"""Reversible line deduplication: sharded cuckoo filters over exact counts.

A text is split at line feeds; a line's key is the line without ASCII white
space at its ends and with A-Z lowered. A key that stands in at least
``min_docs`` documents, and has at least ``min_chars`` code points, is hot: all
its lines go, in every document.

``LineIndex`` is the state. ``members`` has one row per document and distinct
key (a 16-byte BLAKE2 digest), ``refs`` the exact number of documents of each
key, ``filters`` one cuckoo filter per shard (a range of digests) with the
fingerprints of its hot keys. ``update`` inserts documents and deletes others:
counts change by the difference, and only keys that cross the threshold are
added to or removed from their shard's filter. Since counts are exact and
members are kept, deleting what was inserted gives back the same state, and
every decision can be undone.

``drop_lines`` asks the filters while it reads the texts, so that only lines
that are hot (or collide with a hot one, about 1 in 8,000) are shuffled; they
are confirmed against ``refs`` before anything goes. The filters are broadcast
up to ``BROADCAST_BYTES`` (about 25 million hot keys); beyond it every key of a
document goes to the exact join, with the same result.

Scale: nothing is grouped by document or key but counts and a document's own
hot keys. A key that a third of all documents hold is counted by (key,
document) first; its hits meet one row of ``refs`` in a sort-merge join, which
Spark splits. A shard holds about ``PER_SHARD`` hot keys whatever their number.

Cases: null and empty texts are one empty line, whose key is never hot if
``min_chars`` is 1 or more (a null text stays null); rows that share an id are one document, of which a
line counts once; rows without id are not counted, but lose their hot lines;
lines of any length are keyed whole; an empty table gives an empty result and
an index without keys; columns named ``n_lines`` or ``n_dropped`` are replaced,
all others stay. Inserting an id that the index has adds its lines to that
document; unknown ids among those to delete are ignored; an id that is deleted
and inserted in one call is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epilens.llm.common import fresh, lean, prepare, stage, to_bytes

MIN_DOCS, MIN_CHARS = 10, 1
PER_SHARD, LEAST_SHARDS = 1 << 16, 16
BROADCAST_BYTES = 64 << 20
SLOTS, KICKS, FULL = 4, 200, 0.85
_SPACE = b" \t\n\x0b\x0c\r"
_FILTERS = "shard int, hot long, slots binary, stash array<long>"


def line_key(line: bytes) -> bytes:
    return line.strip(_SPACE).lower()


def _digests(text: str | None, min_chars: int) -> list[bytes | None]:
    """Per line its key's digest, None for one that is too short."""
    out: list[bytes | None] = []
    for line in to_bytes(text).split(b"\n"):
        key = line_key(line)
        long = len(key) >= min_chars and (min_chars < 2 or len(key.decode("utf-8", "surrogatepass")) >= min_chars)
        out.append(blake2b(key, digest_size=16).digest() if long else None)
    return out


class Cuckoo:
    """16-bit fingerprints, four to a bucket, each in one of two buckets. What
    finds no place after ``KICKS`` moves is kept whole in ``stash``."""

    def __init__(self, slots: bytes, stash=()):
        self.table = np.frombuffer(slots, np.uint16).reshape(-1, SLOTS).copy()
        self.mask, self.stash = len(self.table) - 1, list(stash)

    @staticmethod
    def empty(keys: int) -> Cuckoo:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, keys) / (SLOTS * FULL)))))
        return Cuckoo(bytes(2 * SLOTS * buckets))

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        """The last eight bytes of each digest; the first four give the shard."""
        return np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)[:, 1]

    def _places(self, h: np.ndarray):
        h = h.view(np.uint64)
        mark = (h & np.uint64(0xFFFF)).astype(np.int64)
        mark[mark == 0] = 1
        one = ((h >> np.uint64(16)) & np.uint64(self.mask)).astype(np.int64)
        return mark, one, one ^ self._other(mark)

    def _other(self, mark):
        return (mark * 0x5BD1E995 >> 8) & self.mask

    def has(self, h: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(h)
        found = (self.table[one] == mark[:, None]).any(axis=1) | (self.table[two] == mark[:, None]).any(axis=1)
        return found | np.isin(h, np.array(self.stash, np.int64)) if self.stash else found

    def add(self, h: np.ndarray) -> None:
        for own, mark, one, two in zip(h.tolist(), *(x.tolist() for x in self._places(h))):
            if not (self._put(one, mark) or self._put(two, mark) or self._kick(one, mark)):
                self.stash.append(own)

    def _put(self, bucket: int, mark: int) -> bool:
        free = np.flatnonzero(self.table[bucket] == 0)
        if len(free):
            self.table[bucket, free[0]] = mark
        return len(free) > 0

    def _kick(self, bucket: int, mark: int) -> bool:
        """Move others on; if that does not end, every move is taken back."""
        moves = []
        for n in range(KICKS):
            slot = (n * 7 + mark) % SLOTS
            old = int(self.table[bucket, slot])
            moves.append((bucket, slot, old))
            self.table[bucket, slot], mark = mark, old
            bucket ^= self._other(mark)
            if self._put(bucket, mark):
                return True
        for bucket, slot, old in reversed(moves):
            self.table[bucket, slot] = old
        return False

    def remove(self, h: np.ndarray) -> None:
        """Keys that were added."""
        for own, mark, one, two in zip(h.tolist(), *(x.tolist() for x in self._places(h))):
            if own in self.stash:
                self.stash.remove(own)
                continue
            bucket = one if (self.table[one] == mark).any() else two
            self.table[bucket, np.flatnonzero(self.table[bucket] == mark)[0]] = 0


@dataclass
class LineIndex:
    members: DataFrame  # doc_id long, key binary
    refs: DataFrame  # key binary, docs long
    filters: DataFrame  # shard int, hot long, slots binary, stash array<long>
    shards: int
    min_docs: int
    min_chars: int

    def hot(self) -> DataFrame:
        return self.refs.where(F.col("docs") >= self.min_docs).select("key")


def _shard(shards: int) -> Column:
    """The highest bits of the digest: twice the shards part each shard in two."""
    first = F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long")
    return F.shiftright(first, 32 - shards.bit_length() + 1).cast("int").alias("shard")


def _shard_of(key: bytes, shards: int) -> int:
    return int.from_bytes(key[:4], "big") >> 32 - shards.bit_length() + 1


def _shards_for(hot: int) -> int:
    return max(LEAST_SHARDS, 1 << max(0, (hot - 1) // PER_SHARD).bit_length())


def _keys(docs: DataFrame, name: str, text: str, min_chars: int, sent=None, shards: int = 0) -> DataFrame:
    """(name, key) of the distinct keys of each row; with filters those that
    they may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = None if sent is None else {s: Cuckoo(slots, stash) for s, slots, stash in sent.value}
        for b in batches:
            rows, keys = [], []
            for i, t in enumerate(b.column(1)):
                own = {d for d in _digests(t.as_py(), min_chars) if d is not None}
                rows += [i] * len(own)
                keys += own
            if filters is not None and keys:
                found, shard = np.zeros(len(keys), bool), np.array([_shard_of(k, shards) for k in keys])
                h = Cuckoo.hashes(keys)
                for s in np.unique(shard).tolist():
                    if s in filters:
                        own = np.flatnonzero(shard == s)
                        found[own] = filters[s].has(h[own])
                rows, keys = np.array(rows)[found], [keys[i] for i in np.flatnonzero(found)]
            if len(keys):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows, pa.int64())), pa.array(keys, pa.binary())], names=[name, "key"]
                )

    return docs.select(F.col(f"`{name}`").cast("long").alias(name), F.col(f"`{text}`").alias("_text")).mapInArrow(
        lean(run), f"`{name}` long, key binary"
    )


def _members(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return _keys(own.where(F.col("doc_id").isNotNull()), "doc_id", "text", min_chars).distinct()


def build_index(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS
) -> LineIndex:
    """The index of ``docs`` alone."""
    prepare(docs.sparkSession)
    members = stage(_members(docs, doc_id, text, min_chars), "line-members")
    refs = stage(members.groupBy("key").agg(F.count("*").alias("docs")), "line-refs")
    shards = _shards_for(refs.where(F.col("docs") >= min_docs).count())
    filters = stage(_filters(refs, min_docs, shards), "line-filters")
    return LineIndex(members, refs, filters, shards, min_docs, min_chars)


def _filter_row(shard: int, hot: int, c: Cuckoo) -> pa.Table:
    return pa.table(
        {"shard": pa.array([shard], pa.int32()), "hot": pa.array([hot], pa.int64()),
         "slots": pa.array([c.table.tobytes()], pa.binary()), "stash": pa.array([c.stash], pa.list_(pa.int64()))}
    )


def _filters(refs: DataFrame, min_docs: int, shards: int) -> DataFrame:
    """A filter of every shard that has hot keys."""

    def fill(t: pa.Table) -> pa.Table:
        c = Cuckoo.empty(t.num_rows)
        c.add(Cuckoo.hashes(sorted(t["key"].to_pylist())))
        return _filter_row(t["shard"][0].as_py(), t.num_rows, c)

    hot = refs.where(F.col("docs") >= min_docs).select(_shard(shards), "key")
    return hot.groupBy("shard").applyInArrow(fill, _FILTERS)


def update(
    index: LineIndex,
    inserts: DataFrame | None = None,
    deletes: DataFrame | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
) -> LineIndex:
    """The index after the documents named in ``deletes`` (ids) have gone and
    those of ``inserts`` (ids and texts) have come. ``index`` stays as it is."""
    kept, changes = index.members, []
    prepare(kept.sparkSession)
    if deletes is not None:
        ids = deletes.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
        changes.append(kept.join(ids, "doc_id", "left_semi").select("key", F.lit(-1).alias("by")))
        kept = kept.join(ids, "doc_id", "left_anti")
    members = kept
    if inserts is not None:
        new = _members(inserts, doc_id, text, index.min_chars).join(kept, ["doc_id", "key"], "left_anti")
        new = stage(new, "line-new")
        changes.append(new.select("key", F.lit(1).alias("by")))
        members = kept.unionByName(new)
    if not changes:
        return index
    rows = changes[0] if len(changes) == 1 else changes[0].unionByName(changes[1])
    by = rows.groupBy("key").agg(F.sum("by").alias("by"))
    before = F.coalesce("docs", F.lit(0)).alias("before")
    counts = index.refs.join(by, "key", "full").select("key", before, (before + F.coalesce("by", F.lit(0))).alias("docs"))
    counts, members = stage(counts.where("before > 0 OR docs > 0"), "line-counts"), stage(members, "line-members")
    refs = counts.where("docs > 0").select("key", "docs")

    was, now = F.col("before") >= index.min_docs, F.col("docs") >= index.min_docs
    shards = max(index.shards, _shards_for(refs.where(now).count()))
    if shards > index.shards:
        filters = _filters(refs, index.min_docs, shards)
    else:
        filters = _crossed(index, counts.where(was != now).select(_shard(shards), "key", now.alias("add")), refs)
    return LineIndex(members, refs, stage(filters, "line-filters"), shards, index.min_docs, index.min_chars)


def _crossed(index: LineIndex, changed: DataFrame, refs: DataFrame) -> DataFrame:
    """The filters after the keys that crossed the threshold. A shard that
    would be too full gets a larger filter, made of all its hot keys."""
    growth = changed.groupBy("shard").agg(F.sum(F.when(F.col("add"), 1).otherwise(-1)).alias("by"))
    room = index.filters.select("shard", "hot", (F.length("slots") / 2 * FULL).alias("room"))
    full = growth.join(room, "shard", "left").where(F.coalesce("hot", F.lit(0)) + F.col("by") > F.coalesce("room", F.lit(0.0)))
    full = full.select("shard")
    every = refs.where(F.col("docs") >= index.min_docs).select(_shard(index.shards), "key").join(full, "shard", "left_semi")
    todo = changed.join(full, "shard", "left_anti").withColumn("anew", F.lit(False))
    todo = todo.unionByName(every.select("shard", "key", F.lit(True).alias("add"), F.lit(True).alias("anew")))

    def apply(old: pa.Table, new: pa.Table) -> pa.Table:
        if not new.num_rows:
            return old
        anew = new["anew"][0].as_py()
        key, add = new["key"].to_pylist(), new["add"].to_pylist()
        plus, minus = (sorted(k for k, a in zip(key, add) if a == want) for want in (True, False))
        if anew or not old.num_rows:
            c, hot = Cuckoo.empty(len(plus)), 0
        else:
            c, hot = Cuckoo(old["slots"][0].as_py(), old["stash"][0].as_py()), old["hot"][0].as_py()
        c.remove(Cuckoo.hashes(minus))
        c.add(Cuckoo.hashes(plus))
        return _filter_row(new["shard"][0].as_py(), hot + len(plus) - len(minus), c)

    return index.filters.groupBy("shard").cogroup(todo.groupBy("shard")).applyInArrow(apply, _FILTERS)


def drop_lines(docs: DataFrame, index: LineIndex, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the lines that are hot in ``index``, with ``n_lines``
    (before) and ``n_dropped``."""
    spark = docs.sparkSession
    prepare(spark)
    size = index.filters.agg(F.coalesce(F.sum(F.length("slots") + 8 * F.size("stash")), F.lit(0))).first()[0]
    sent = None
    if size <= BROADCAST_BYTES:
        sent = spark.sparkContext.broadcast([tuple(r) for r in index.filters.select("shard", "slots", "stash").collect()])
    # a row is known by its id and text: repeated rows share their hot keys
    row, hot_keys = fresh(docs, "_row"), fresh(docs, "_hot")
    min_chars = index.min_chars
    rows = docs.withColumn(row, F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`")))
    hits = _keys(rows, row, text, min_chars, sent, index.shards)
    confirmed = hits.join(index.hot(), "key", "left_semi").groupBy(row).agg(F.collect_set("key").alias(hot_keys))
    joined = rows.join(confirmed, row, "left")

    @F.arrow_udf("kept string, n_lines long, n_dropped long")
    def split(texts: pa.Array, hot: pa.Array) -> pa.Array:
        kept, n_lines, n_dropped = [], [], []
        for t, keys in zip(texts, hot):
            t, own = t.as_py(), set(keys.as_py() or ())
            if not own:
                kept.append(t)
                n_lines.append(t.count("\n") + 1 if t else 1)
                n_dropped.append(0)
                continue
            lines = to_bytes(t).split(b"\n")
            stay = [x for x, d in zip(lines, _digests(t, min_chars)) if d not in own]
            kept.append(None if t is None else b"\n".join(stay).decode("utf-8", "surrogatepass"))
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(stay))
        return pa.StructArray.from_arrays(
            [pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
            names=["kept", "n_lines", "n_dropped"],
        )

    done = fresh(docs, "_done")
    joined = joined.withColumn(done, split(F.col(f"`{text}`"), F.col(hot_keys)))
    keep = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return joined.select(
        *[F.col(f"{done}.kept").alias(c) if c == text else F.col(f"`{c}`") for c in keep],
        F.col(f"{done}.n_lines").alias("n_lines"),
        F.col(f"{done}.n_dropped").alias("n_dropped"),
    )


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` without the lines that are hot among them."""
    return drop_lines(docs, build_index(docs, doc_id, text, min_docs, min_chars), doc_id, text)
