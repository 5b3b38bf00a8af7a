"""Near-duplicate documents by one-permutation MinHash.

A document's set holds the hashes of its distinct ``width``-word shingles.
One hash function deals the set over ``BINS`` bins; a bin keeps its smallest
value, and an empty bin takes the value of the first non-empty bin of its own
fixed probe sequence (optimal densification). ``BAND_ROWS`` bins make a band;
documents that agree on a band share a bucket.

Equal sets are one class, represented by its smallest id. Classes of a bucket
are linked in a star, first around its smallest id. A document is compared with
at most ``CENTRES`` centres per turn, those that it shares most buckets with, so
the pairs of a turn are at most as many times the documents, whatever the size
of a bucket. Buckets whose members end in several components take part in the
next turn: the members outside the component of the bucket's hub (the member
that shares most bucket places with others, such as the origin of a family of
copies) are compared with the hub, the smallest id and a member drawn by hash,
and only they and these centres go on to the turn after that. The turns end
when one confirms no new link. Then every pair that shares a bucket, and whose
ends are in different components, is compared on the full sets: in a bucket of
at most ``PAIRED`` members pair by pair (those not met before), in a larger one
by blocks of its members, each block against each other one in a group of its
own, so that a task holds one block whatever the size of the bucket. Pairs
within the bucket's largest component are left out, since they are linked.
Every link is confirmed on the full sets of both texts.

Cases: null, empty or wordless texts have the empty set and are linked with
nothing; a text of fewer words than ``width`` is one shingle; rows without id
are never linked and have no component; repeated rows each get a row of the
result; an id given with several texts is one document, linked by any of
them; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epilens.llm.common import cut, fresh, lean, mix64, prepare, shingle_set, space_words, stage, WordHash
from epilens.llm.components import connected_components

BINS, BAND_ROWS = 128, 6  # 21 bands: at similarity 0.85 a pair shares none with probability 5e-5
CENTRES = 3  # per document and turn
PAIRED = 32  # members of a bucket that is compared pair by pair
BLOCK, BLOCK_SHINGLES = 256, 1 << 18  # of a larger one, on average
_SHIFT = np.uint64(64 - BINS.bit_length() + 1)
_SIGNATURE = "doc_id long, n_shingles long, set_id binary, bands array<long>, row long"


def _probes(attempt: int) -> np.ndarray:
    """The bin that each bin looks at in its ``attempt``-th try."""
    n = np.arange(BINS, dtype=np.uint64) + np.uint64(attempt * BINS + 1)
    return (mix64(n) >> _SHIFT).astype(np.int64)


_FIRST_PROBES = [_probes(a) for a in range(64)]


def signature(own: np.ndarray) -> np.ndarray:
    """Densified bins of a non-empty sorted set of 64-bit hashes."""
    edges = np.arange(BINS, dtype=np.uint64) << _SHIFT
    first = np.searchsorted(own, edges)
    last = np.append(first[1:], len(own))
    full = first < last
    out = own[np.minimum(first, len(own) - 1)]
    empty, attempt = np.flatnonzero(~full), 0
    while len(empty):
        probe = (_FIRST_PROBES[attempt] if attempt < 64 else _probes(attempt))[empty]
        hit = full[probe]
        out[empty[hit]] = out[probe[hit]]
        empty = empty[~hit]
        attempt += 1
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    n = BINS // BAND_ROWS
    rows = sig[: n * BAND_ROWS].reshape(n, BAND_ROWS)
    h = np.arange(1, n + 1, dtype=np.uint64)
    for j in range(BAND_ROWS):
        h = mix64(h ^ rows[:, j])
    return h.view(np.int64)


def signatures(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for b in batches:
            n, ids, found = [], [], []
            for t in b.column(1):
                own = shingle_set(words.of(space_words(t.as_py())), width)
                n.append(len(own))
                ids.append(blake2b(own.tobytes(), digest_size=16).digest())
                found.append(bands(signature(own)) if len(own) else np.empty(0, np.int64))
            offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else [], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), lists, b.column(2)],
                names=["doc_id", "n_shingles", "set_id", "bands", "row"],
            )

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), _row(doc_id, text).alias("row"))
    return rows.mapInArrow(lean(run), _SIGNATURE)


def _row(doc_id: str, text: str) -> Column:
    """A row is known by its id and text; an id may come with several texts."""
    return F.xxhash64(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`"))


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have
    100 * intersection >= percent * union. texts: (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        last, of_a = None, None  # rows come sorted by a
        for batch in batches:
            keep = []
            for a, ta, tb in zip(*(batch.column(k) for k in (0, 2, 3))):
                if last is None or last[0] != a or last[1] != ta:
                    last, of_a = (a, ta), shingle_set(words.of(space_words(ta.as_py())), width)
                of_b = shingle_set(words.of(space_words(tb.as_py())), width)
                both = len(np.intersect1d(of_a, of_b, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(of_a) + len(of_b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    member = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    centre = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    rows = pairs.select("a", "b").join(member, "b").join(centre, "a").select("a", "b", "ta", "tb")
    return rows.mapInArrow(lean(run), "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = 5,
    percent: int = 80,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per document row."""
    sig, classes, links = _linked(docs, doc_id, text, width, percent)
    # an id that stands in several classes ties them together
    named = sig.join(classes, F.expr(_OWN_CLASS)).select("doc_id", "rep").where("doc_id IS NOT NULL").distinct()
    several = named.groupBy("doc_id").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x <> y")
    ties = named.join(several.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    of_class = _of_class(classes, links.union(cut(ties)))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return sig.drop("bands", "row").join(of_class, F.expr(_OWN_CLASS), "left").select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
    )


_OWN_CLASS = "set_id = class_id"


def _of_class(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(class_id, component_id): the smallest representative that is reached."""
    found = connected_components(links, "a", "b")
    return classes.join(found, F.col("rep") == F.col("node"), "left").select(
        "class_id", F.coalesce("component", "rep").alias("component_id")
    )


def _parted(sig: DataFrame) -> DataFrame:
    """``sig`` with a negative number in place of every id that comes with
    several sets, one for each; ``own_id`` keeps the id."""
    sets = sig.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("of"))
    several = cut(sets.agg(F.min("set_id").alias("x"), F.max("set_id").alias("y")).where("x <> y").select("of"))
    named = sig.withColumn("own_id", F.col("doc_id"))
    if several.isEmpty():
        return named
    number = -F.pmod(F.xxhash64("own_id", "set_id"), F.lit(1 << 62)) - 1
    joined = named.drop("doc_id").join(several, F.col("own_id") == F.col("of"), "left")
    return stage(joined.withColumn("doc_id", F.when(F.col("of").isNotNull(), number).otherwise(F.col("own_id"))).drop("of"), "minhash-parted")


def _linked(
    docs: DataFrame, doc_id: str, text: str, width: int, percent: int, by_text: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signatures, classes of equal sets, links between the classes'
    representatives). ``by_text``: the texts of an id are documents of their
    own."""
    sig = stage(signatures(docs, doc_id, text, width), "minhash-signatures")
    if by_text:
        sig = _parted(sig)
    classes = sig.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("rep"))
    # kept, so that the joins on set_id have plain exchanges, whose hot groups Spark splits
    classes = cut(classes.select(F.col("set_id").alias("class_id"), "rep"))
    own_class = F.col("set_id") == F.col("class_id")
    first = sig.join(classes, own_class & (F.col("doc_id") == F.col("rep")), "left_semi")
    places = first.select(F.col("doc_id").alias("doc"), F.explode("bands").alias("h"))
    shared = places.groupBy("h").agg(F.count("*").alias("size"), F.min("doc").alias("low"), F.max("doc").alias("high"))
    places = stage(places.join(shared.where("low <> high").drop("high"), "h"), "minhash-buckets")
    # a document is in one bucket per band: the lists are short
    members = places.groupBy("doc").agg(F.sum("size").alias("weight"), F.collect_list("low").alias("lows"))
    members = cut(members.join(first.select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n")).distinct(), "doc"))

    own = docs.select(_row(doc_id, text).alias("row"), F.col(f"`{text}`").alias("text"))
    shown = first.join(members, F.col("doc_id") == F.col("doc"), "left_semi").select("doc_id", "row").distinct()
    texts = stage(own.join(shown, "row").select("doc_id", "text"), "minhash-texts")

    pairs = cut(_most_shared(members.select("doc", F.array_remove("lows", F.col("doc")).alias("centres"))))
    links = cut(confirm(pairs, texts, width, percent), wide=True)
    tested, buckets, turn = pairs, places.select("h", "doc"), 0
    while True:
        turn += 1
        found = connected_components(links, "a", "b")
        known = members.select("doc", "n", "weight").join(found, F.col("doc") == F.col("node"), "left")
        known = known.withColumn("component", F.coalesce("component", "doc")).drop("node")
        left = cut(_outside(buckets.join(known, "doc"), turn))
        pairs = cut(_untested(left, tested, percent))
        new = cut(confirm(pairs, texts, width, percent), wide=True)
        if new.isEmpty():
            break
        links, tested = links.union(new), tested.union(pairs)
        centres = [left.select("h", F.col(f"{c}.doc").alias("doc")) for c in ("hub", "low", "drawn")]
        buckets = left.select("h", "doc").union(centres[0]).union(centres[1]).union(centres[2]).distinct()
    rest = cut(_rest(places.select("h", "doc").join(known, "doc")))
    pairs = _unmet_pairs(rest.where(F.col("members") <= PAIRED), tested, percent)
    new = cut(confirm(pairs, texts, width, percent), wide=True)
    blocks = rest.where(F.col("members") > PAIRED)
    if not blocks.isEmpty():
        new = new.union(cut(_block_links(blocks, texts, width, percent), wide=True))
    return sig, classes, links.union(new)


def _most_shared(rows: DataFrame) -> DataFrame:
    """(a, b) of (doc, centres): the centres that stand in the list most
    often, the smaller first on ties."""
    distinct = F.array_distinct("centres")
    counted = F.transform(
        distinct, lambda c: F.struct(F.size(F.filter("centres", lambda x: x == c)).alias("shared"), (-c).alias("minus"))
    )
    best = F.slice(F.sort_array(counted, asc=False), 1, CENTRES)
    return rows.select(F.explode(best).alias("c"), F.col("doc").alias("b")).select((-F.col("c.minus")).alias("a"), "b")


def _outside(rows: DataFrame, turn: int) -> DataFrame:
    """Members outside the component of their bucket's hub, with the bucket's
    centres. rows: (h, doc, n, weight, component)."""
    member = F.struct("doc", "n", "component")
    centres = rows.groupBy("h").agg(
        F.max_by(member, F.struct("weight", -F.col("doc"))).alias("hub"),
        F.min_by(member, "doc").alias("low"),
        F.max_by(member, F.xxhash64("doc", "h", F.lit(turn))).alias("drawn"),
        F.min("component").alias("x"),
        F.max("component").alias("y"),
    )
    centres = centres.where("x <> y").select(F.col("h").alias("of"), "hub", "low", "drawn")
    return rows.join(centres, (F.col("h") == F.col("of")) & (F.col("component") != F.col("hub.component"))).drop("of")


def _untested(left: DataFrame, tested: DataFrame, percent: int) -> DataFrame:
    """(a, b): members with the centres that they have not met, outside their
    component, and of a size that allows a link."""

    def fits(c):
        size = 100 * F.least(c["n"], F.col("n")) >= percent * F.greatest(c["n"], F.col("n"))
        return (c["component"] != F.col("component")) & size

    centres = F.transform(F.filter(F.array("hub", "low", "drawn"), fits), lambda c: c["doc"])
    met = tested.groupBy("b").agg(F.collect_list("a").alias("met"))  # at most CENTRES per turn
    lists = left.groupBy("doc").agg(F.flatten(F.collect_list(centres)).alias("centres"))
    lists = lists.join(met, F.col("doc") == F.col("b"), "left")
    unmet = F.filter("centres", lambda c: ~F.coalesce(F.array_contains("met", c), F.lit(False)))
    return _most_shared(lists.select("doc", unmet.alias("centres")))


def _rest(rows: DataFrame) -> DataFrame:
    """Members of the buckets with several components, with whether each is in
    the bucket's largest component (``inside``) and the blocks of either side.
    rows: (h, doc, n, weight, component)."""
    sizes = rows.groupBy("h", "component").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
    sizes = sizes.groupBy("h").agg(
        F.max_by(F.struct("component", "size", "shingles"), F.struct("size", "component")).alias("top"),
        F.sum("size").alias("members"),
        F.sum("shingles").alias("shingles"),
    )
    sizes = sizes.where(F.col("members") > F.col("top.size"))

    def blocks(size, shingles):
        return F.ceil(F.greatest(size / BLOCK, shingles / BLOCK_SHINGLES)).cast("int")

    sizes = sizes.select(
        F.col("h").alias("of"),
        F.col("top.component").alias("largest"),
        "members",
        blocks(F.col("top.size"), F.col("top.shingles")).alias("in_blocks"),
        blocks(F.col("members") - F.col("top.size"), F.col("shingles") - F.col("top.shingles")).alias("out_blocks"),
    )
    found = rows.join(sizes, F.col("h") == F.col("of"))
    return found.select(
        "h", "doc", "n", "component", "members", "in_blocks", "out_blocks", (F.col("component") == F.col("largest")).alias("inside")
    )


def _unmet_pairs(rest: DataFrame, tested: DataFrame, percent: int) -> DataFrame:
    """(a, b): all pairs of a bucket in different components, of sizes that
    allow a link, that were not compared in a turn."""
    lists = rest.groupBy("h").agg(F.collect_list(F.struct("doc", "n", "component")).alias("all"))
    rows = lists.select(F.explode("all").alias("x"), "all").select("x", F.explode("all").alias("y"))
    x, y = F.col("x"), F.col("y")
    fits = 100 * F.least(x["n"], y["n"]) >= percent * F.greatest(x["n"], y["n"])
    rows = rows.where((x["doc"] < y["doc"]) & (x["component"] != y["component"]) & fits)
    met = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return rows.select(x["doc"].alias("a"), y["doc"].alias("b")).distinct().join(met, ["a", "b"], "left_anti")


def _block_links(rest: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): links that join the components of a bucket, by comparing every
    block of the members outside its largest component with every block of
    either side; of each two blocks a spanning forest of the links."""
    sides = rest.withColumn("blocks", F.when(F.col("inside"), F.col("in_blocks")).otherwise(F.col("out_blocks")))
    own = F.pmod(F.xxhash64("doc", "h"), F.col("blocks")).cast("int")

    def upto(n):
        return F.sequence(F.lit(0), n - 1)

    def meeting(i, j, inside: bool, held):
        return F.struct(i.alias("i"), j.alias("j"), F.lit(inside).alias("with_inside"), held.alias("held"))

    out = F.concat(
        F.transform(upto(F.col("out_blocks")), lambda k: meeting(F.least(k, F.col("own")), F.greatest(k, F.col("own")), False, F.col("own") <= k)),
        F.transform(upto(F.col("in_blocks")), lambda k: meeting(F.col("own"), k, True, F.lit(True))),
    )
    inside = F.transform(upto(F.col("out_blocks")), lambda k: meeting(k, F.col("own"), True, F.lit(False)))
    meetings = sides.withColumn("own", own).select(
        "h", "doc", "component", F.explode(F.when(F.col("inside"), inside).otherwise(out)).alias("m")
    )
    meetings = meetings.select("h", "doc", "component", "m.i", "m.j", "m.with_inside", "m.held")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for b in batches:
            found = [shingle_set(words.of(space_words(t.as_py())), width).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["id", "shingles"])

    wanted = texts.join(rest.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi")
    wanted = wanted.select("doc_id", "text").mapInArrow(lean(sets), "id long, shingles binary")
    # a representative that stands with several texts has a set of each
    rows = meetings.join(wanted, F.col("doc") == F.col("id")).drop("id")

    def pairs_batch(pairs):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, None  # rows come sorted: a block's own members first
        for b in batches:
            keys = list(zip(*(b.column(k).to_pylist() for k in ("h", "i", "j", "with_inside"))))
            out: list[tuple[int, int]] = []
            for key, doc, part, held, own in zip(keys, *(b.column(k) for k in ("doc", "component", "held", "shingles"))):
                if key != at:
                    out += _own_links(at, block)
                    at, block = key, _Block(percent)
                own = np.frombuffer(own.as_buffer(), np.uint64)
                out += block.meet(doc.as_py(), part.as_py(), own, held.as_py())
            if out:
                yield pairs_batch(out)
        out = _own_links(at, block)
        if out:
            yield pairs_batch(out)

    n = int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("h"), F.col("i"), F.col("j"), F.col("with_inside"), F.col("held").desc(), F.col("doc")]
    dealt = rows.repartition(n, "h", "i", "j", "with_inside").sortWithinPartitions(*order)
    return dealt.mapInArrow(lean(run), "a long, b long").distinct()


def _own_links(at, block: _Block | None) -> list[tuple[int, int]]:
    """Links within a block, in the group where it meets itself."""
    return block.among() if at is not None and at[1] == at[2] and not at[3] else []


class _Block:
    """The members of one block; each later member is compared with all of
    them at once. Components that a link has joined are one from then on."""

    def __init__(self, percent: int):
        self.percent, self.root = percent, {}
        self.docs, self.parts, self.sets, self.index = [], [], [], None

    def _find(self, x: int) -> int:
        while self.root.setdefault(x, x) != x:
            self.root[x] = x = self.root[self.root[x]]
        return x

    def _built(self):
        """Distinct shingles of the block, sorted, with the members that hold each."""
        if self.index is None:
            sizes = np.array([len(s) for s in self.sets])
            flat = np.concatenate(self.sets)
            holder = np.repeat(np.arange(len(sizes)), sizes)
            order = np.argsort(flat, kind="stable")
            self.index = flat[order], holder[order], sizes
        return self.index

    def _counts(self, own: np.ndarray) -> np.ndarray:
        flat, holder, sizes = self._built()
        low, high = np.searchsorted(flat, own), np.searchsorted(flat, own, side="right")
        many = high - low
        ends = np.cumsum(many)
        places = np.arange(ends[-1]) + np.repeat(low - (ends - many), many)
        return np.bincount(holder[places], minlength=len(sizes))

    def meet(self, doc: int, part: int, own: np.ndarray, held: bool) -> list[tuple[int, int]]:
        if held:
            self.docs.append(doc)
            self.parts.append(part)
            self.sets.append(own)
            return []
        return self._links(doc, part, own, len(self.docs)) if self.docs else []

    def _links(self, doc: int, part: int, own: np.ndarray, upto: int) -> list[tuple[int, int]]:
        both, sizes = self._counts(own)[:upto], self._built()[2][:upto]
        near = np.flatnonzero((both > 0) & (100 * both >= self.percent * (sizes + len(own) - both)))
        out = []
        for k in near.tolist():
            x, y = self._find(part), self._find(self.parts[k])
            if x != y:
                self.root[max(x, y)] = min(x, y)
                out.append((min(doc, self.docs[k]), max(doc, self.docs[k])))
        return out

    def among(self) -> list[tuple[int, int]]:
        """Links between the members of the block."""
        return [p for k in range(1, len(self.docs)) for p in self._links(self.docs[k], self.parts[k], self.sets[k], k)]


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the one with
    the smallest id, of its texts in the group the one with most shingles. Each
    text of an id that comes with several is judged for itself; rows equal in
    id and text count once; texts without words, and rows without id, stay."""
    sig, classes, links = _linked(docs, doc_id, text, width, percent, by_text=True)
    of_class = cut(_of_class(classes, links))
    rows = sig.where("doc_id IS NOT NULL").join(of_class, F.expr(_OWN_CLASS), "left")
    best = rows.where("component_id IS NOT NULL").groupBy("component_id").agg(
        F.min(F.struct("own_id", (-F.col("n_shingles")).alias("shorter"), "row")).alias("first")
    )
    own = fresh(docs, "_row")
    ids = best.select(F.col("first.row").alias(own)).union(rows.where("component_id IS NULL").select(F.col("row").alias(own)))
    named = docs.withColumn(own, _row(doc_id, text)).where(F.col(f"`{doc_id}`").isNotNull())
    kept = named.join(ids.distinct(), own, "left_semi").dropDuplicates([own]).drop(own)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where(F.col(f"`{doc_id}`").isNull()))
