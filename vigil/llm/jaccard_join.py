"""Near-duplicate documents: an exact join on the Jaccard similarity of word-shingle sets.

Method: parity sketches. A set's shingle hashes fall into a number of cells fixed by its size
band; a cell keeps the exclusive-or of its hashes. One differing shingle changes one cell, so
the cells in which two sets differ are at most as many as the shingles in which they differ:
the sketch distance bounds the symmetric difference from below. Sets of a and b shingles that
are similar by ``percent`` differ in at most D = (100 - p)(a + b) / (100 + p) shingles, so by
the pigeonhole principle any D + 1 filled cells of one set, chosen by one order for all sets,
and the D + 1 of the other have an equal cell. The order is rarest first, over counts of the
whole corpus. Candidates are verified on the whole shingle sets of their texts.

Bands are size ranges of ratio four; a set near the upper end of its band is sketched for the
next one too. Below 64 shingles each shingle has a cell of its own, so the principle always
holds; above, sets fill more than half of twice as many cells as the band's least size, and
for it to fail two thirds of a set's shingles would have to share cells.

Equal sets are one class with its smallest id as representative; only representatives are
joined. A cell that at most ``SMALL`` documents share gives all its pairs. A more frequent one
links its members to its first. Where that leaves members in different components, their bit
sketches, 8 to 32 bits a shingle, are compared in blocks of ``BLOCK`` members: those outside the
largest component with all. Only pairs from different components whose distance allows a link
go on to be verified; where those are many, the nearest first, then what still lies apart. So no link between components is missed, and
no pair inside one is listed.

Defined cases: a null or empty text, or one of white space, has the empty set, which is
linked with nothing; a text without id joins the class of an equal set but no link; rows with one id are one document whose links are
united; repeated rows repeat in the result; an empty table gives an empty result; other
columns are ignored. Texts are used whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import exchange as X, kit
from .graph import components

#: Buckets of documents for each partition.
BUCKETS = 4
#: Documents that share a cell, up to which all their pairs are candidates.
SMALL = 16
#: Members of a group in a block, when their sketches are compared.
BLOCK = 4096
#: Near pairs for each member above which a round takes each visitor's nearest only; the last round takes all.
MOST_PAIRS = (8.0, 8.0, 8.0, float("inf"))
#: Sets below this size have a cell for each shingle.
TINY_LEVEL = 2
U64 = np.uint64


class Sets:
    """Sorted distinct shingle hashes of every text."""

    def __init__(self, column, width: int):
        data, offsets = kit.texts(column)
        data = kit.lower(data)
        start, end, first = kit.words(data, offsets)
        n = np.diff(first)
        sums = kit.prefix(kit.word_hashes(data, start, end))
        count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
        at = np.concatenate([[0], np.cumsum(count)])
        begin = np.repeat(first[:-1], count) + np.arange(at[-1]) - np.repeat(at[:-1], count)
        h = kit.span(sums, begin, np.minimum(begin + width, np.repeat(first[1:], count)))
        for a, b in zip(at, at[1:], strict=False):
            h[a:b].sort()
        doc = kit.doc_of(at)
        keep = kit.runs(doc, h)
        self.hash, self.doc = h[keep], doc[keep]
        self.size = np.bincount(self.doc, minlength=len(n))
        self.first = np.concatenate([[0], np.cumsum(self.size)])

    def signature(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits that equal sets share."""
        out = []
        for salt in (U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)):
            sums = np.zeros(len(self.hash) + 1, U64)
            np.cumsum(kit.mix(self.hash ^ salt), out=sums[1:])
            out.append(kit.mix(sums[self.first[1:]] - sums[self.first[:-1]] + self.size.astype(U64)))
        return out[0], out[1]


def differing(size: np.ndarray, percent: int) -> np.ndarray:
    """By how many shingles a set of this size can differ from a similar one."""
    return (100 - percent) * (size + 100 * size // percent) // (100 + percent)


def sketches(sets: Sets, percent: int):
    """Parity cells of every set in its band, and in the next band if a similar set may lie there: key, set, band."""
    level = np.maximum(TINY_LEVEL, (np.log2(np.maximum(sets.size, 1)) // 2).astype(np.int64))
    level -= (sets.size < 4.0**level) & (level > TINY_LEVEL)
    level += sets.size >= 4.0 ** (level + 1)
    keys, docs, bands = [], [], []
    for up in (0, 1):
        here = level + up
        chosen = sets.size > 0 if not up else sets.size * 100 >= percent * 4.0**here
        item = np.flatnonzero(chosen[sets.doc])
        h, doc = sets.hash[item], sets.doc[item]
        band = here[doc]
        cell = np.where(band == TINY_LEVEL, h, h >> (63 - 2 * band).astype(U64))
        runs = kit.runs(doc, cell)
        if len(runs):
            parity = np.bitwise_xor.reduceat(h, runs)
            keys.append(kit.mix(parity ^ kit.mix(band[runs].astype(U64) + U64(1))))
            docs.append(doc[runs])
            bands.append(band[runs])
    if not keys:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(docs), np.concatenate(bands)


class _Bucket:
    def __init__(self, table: pa.Table, width: int, percent: int, parts: int):
        self.docs, self.parts = kit.ids(table["doc_id"]), parts
        self.sets = Sets(table["text"], width)
        shift = X.kept_bits(parts)
        key, self.doc, self.band = sketches(self.sets, percent)
        key = key >> shift << shift
        self.order = np.argsort(key)
        self.sorted = key[self.order]
        self.runs = kit.runs(self.sorted)
        self.cells = self.sorted[self.runs]
        self.filled = np.flatnonzero(self.sets.size)
        s1, s2 = (s[self.filled] for s in self.sets.signature())
        self.set_order = np.lexsort((s2, s1))
        s1, s2 = s1[self.set_order], s2[self.set_order]
        self.set_runs = kit.runs(s1, s2)
        self.s1, self.s2 = s1[self.set_runs], s2[self.set_runs]

    def question(self) -> list[tuple[int, bytes]]:
        """How many sets here have each cell; the smallest id of each distinct set."""
        count = np.minimum(np.diff(self.runs, append=len(self.sorted)), 65535).astype(np.uint16)
        ids = self.docs[self.filled[self.set_order]]
        least = np.minimum.reduceat(ids, self.set_runs) if len(ids) else ids
        cells, sets = dict(X.by_part(self.cells, self.parts)), dict(X.by_part(self.s1, self.parts))
        none = slice(0, 0)
        out = []
        for part in sorted({*cells, *sets}):
            c, s = cells.get(part, none), sets.get(part, none)
            out.append((part, kit.pack(kit.gaps(self.cells[c]), count[c], kit.gaps(self.s1[s]), self.s2[s], least[s])))
        return out

    def read(self, replies: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of each cell here the number of sets that have it; of each row the representative's id."""
        frequent, least = np.zeros(len(self.cells), np.int64), np.zeros(len(self.s1), np.int64)
        cells, sets = dict(X.by_part(self.cells, self.parts)), dict(X.by_part(self.s1, self.parts))
        for part, blob in replies.items():
            f, i = kit.unpack(blob)
            if part in cells:
                frequent[cells[part]] = f
            if part in sets:
                least[sets[part]] = i
        each = np.empty(len(self.sorted), np.int64)
        each[self.order] = np.repeat(frequent, np.diff(self.runs, append=len(self.sorted)))
        first = self.docs.copy()
        first[self.filled[self.set_order]] = np.repeat(least, np.diff(self.set_runs, append=len(self.set_order)))
        return each, first


def _count(blobs: list[bytes]) -> list[bytes]:
    each = [kit.unpack(b) for b in blobs]
    cells, counts, s1, s2, ids = (np.concatenate(c) for c in zip(*[(kit.ungaps(e[0]), e[1], kit.ungaps(e[2]), e[3], e[4]) for e in each], strict=True))
    at = np.concatenate([[0], np.cumsum([len(e[0]) for e in each])])
    to = np.concatenate([[0], np.cumsum([len(e[2]) for e in each])])
    total, least = np.empty(len(cells), np.uint16), np.empty(len(ids), np.int64)
    if len(cells):
        order = np.argsort(cells)
        runs = kit.runs(cells[order])
        sums = np.add.reduceat(counts[order].astype(np.int64), runs)
        total[order] = np.repeat(np.minimum(sums, 65535).astype(np.uint16), np.diff(runs, append=len(cells)))
    if len(ids):
        order = np.lexsort((s2, s1))
        runs = kit.runs(s1[order], s2[order])
        least[order] = np.repeat(np.minimum.reduceat(ids[order], runs), np.diff(runs, append=len(ids)))
    return [kit.pack(total[a:b], least[c:d]) for a, b, c, d in zip(at, at[1:], to, to[1:], strict=False)]


_KINDS = "kind int, doc_id long, n long, class_id long, key long, part int, blob binary, text string"
_FIELDS = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("class_id", pa.int64()), ("key", pa.int64()),
                     ("part", pa.int32()), ("blob", pa.binary()), ("text", pa.string())])
DOC, FEW, MANY, TEXT = range(4)


def _rows(kind: int, rows: int, **columns) -> pa.Table:
    given = {"kind": pa.array(np.full(rows, kind, np.int32))} | columns
    return pa.table([given.get(f.name, pa.nulls(rows, f.type)) for f in _FIELDS], schema=_FIELDS)


def _emit(here: _Bucket, table: pa.Table, replies: dict[int, bytes], percent: int) -> pa.Table:
    """Every document's class, and for representatives the cells to join on and, with those, the text."""
    shared, rep = here.read(replies)
    size = here.sets.size
    # One row stands for a class; a second row with its id and set does not.
    stands = np.zeros(len(size), bool)
    stands[here.filled[here.set_order[here.set_runs]]] = True
    row = here.filled[here.set_order]
    own = np.zeros(len(size), bool)
    own[row] = rep[row] == here.docs[row]
    if len(row):
        # The row to stand for a class is the first with the class's id.
        run = np.repeat(np.arange(len(here.set_runs)), np.diff(here.set_runs, append=len(row)))
        pick = np.lexsort((row, ~own[row], run))
        stands[:] = False
        stands[row[pick[kit.runs(run[pick])]]] = True
        stands &= own
    # Within each set and band: unshared cells come first in the order, then the rarest.
    group = here.doc * 64 + here.band
    limit = differing(size, percent)[here.doc] + 1
    names, place = np.unique(group, return_inverse=True)
    alone = np.bincount(place, weights=shared < 2, minlength=len(names)).astype(np.int64)
    left = limit - alone[place]
    use = np.flatnonzero((shared >= 2) & (left > 0) & stands[here.doc])
    key = np.empty(len(here.sorted), U64)
    key[here.order] = here.sorted
    order = use[np.lexsort((key[use], shared[use], place[use]))]
    runs = kit.runs(place[order])
    rank = np.arange(len(order)) - np.repeat(runs, np.diff(runs, append=len(order)))
    order = order[rank < left[order]]
    out = [_rows(DOC, len(size), doc_id=kit.id_column(here.docs), n=pa.array(size.astype(np.int64)), class_id=kit.id_column(rep))]
    if len(order):
        few = order[shared[order] <= SMALL]
        few = few[np.argsort(key[few])]
        blobs = [(p, kit.pack(kit.gaps(key[few][s]), here.docs[here.doc[few]][s], size[here.doc[few]][s].astype(np.uint32))) for p, s in X.by_part(key[few], here.parts)]
        out.append(_rows(FEW, len(blobs), part=pa.array([p for p, _ in blobs], pa.int32()), blob=pa.array([b for _, b in blobs], pa.binary())))
        many = order[shared[order] > SMALL]
        out.append(_rows(MANY, len(many), doc_id=kit.id_column(here.docs[here.doc[many]]), n=pa.array(size[here.doc[many]].astype(np.int64)), key=pa.array(key[many].view(np.int64)),
                         part=pa.array(here.band[many].astype(np.int32))))
        rows = np.unique(here.doc[order])
        out.append(_rows(TEXT, len(rows), doc_id=kit.id_column(here.docs[rows]), text=table["text"].combine_chunks().take(pa.array(rows))))
    return pa.concat_tables(out)


def _pairs(percent: int):
    """All pairs of sets that share a cell and whose sizes allow a link, each once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [b for batch in batches for b in batch["blob"].to_pylist()]
        if not blobs:
            return
        (key, doc, size), _ = X.joined(blobs)
        order = np.lexsort((doc, key))
        key, doc, size = key[order], doc[order], size[order].astype(np.int64)
        found, step = [], 1
        while len(key) > step:
            at = np.flatnonzero(key[step:] == key[:-step])
            if not len(at):
                break
            a, b = size[at], size[at + step]
            at = at[(100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (doc[at] != doc[at + step])]
            found.append(np.stack([doc[at], doc[at + step]], 1))
            step += 1
        if found:
            pairs = np.unique(np.concatenate(found), axis=0)
            for at in range(0, len(pairs), 10_000):
                some = pairs[at: at + 10_000]
                yield pa.record_batch([pa.array(some[:, 0]), pa.array(some[:, 1])], ["a", "b"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose texts' sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                x, y = Sets(some["x"], width), Sets(some["y"], width)
                linked = np.zeros(some.num_rows, bool)
                for i in range(some.num_rows):
                    p, q = x.hash[x.first[i]: x.first[i + 1]], y.hash[y.first[i]: y.first[i + 1]]
                    if len(p) and len(q):
                        place = np.minimum(np.searchsorted(q, p), len(q) - 1)
                        both = int(np.count_nonzero(q[place] == p))
                        linked[i] = 100 * both >= percent * (len(p) + len(q) - both)
                kept = some.filter(pa.array(linked))
                yield pa.record_batch([kept["a"], kept["b"]], ["a", "b"])

    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def _bit_sketches(width: int):
    """Bit i is the parity of the shingles whose hashes end in i."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, bands = Sets(batch["text"], width), batch["band"].to_numpy()
            out = []
            for i, band in enumerate(bands):
                size = 32 << (2 * int(band))
                place = (sets.hash[sets.first[i]: sets.first[i + 1]] & U64(size - 1)).astype(np.int64)
                out.append(np.packbits(np.bincount(place, minlength=size) & 1).tobytes())
            yield pa.record_batch([batch["a"], batch["band"], pa.array(out, pa.binary())], ["a", "band", "sketch"])

    return run


def _apart(percent: int, most: float):
    """Pairs of a visitor of a block and a resident that lie in different components and may be linked.

    If there are more than ``most`` for each member, those of each visitor with its nearest, and ``again``.
    """

    def run(table: pa.Table) -> pa.Table:
        doc, size, name, visits = (table[c].to_numpy() for c in ("a", "n", "c", "visits"))
        sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), U64).reshape(len(doc), -1)
        here, every, nearest = np.flatnonzero(~visits), [], []
        for i in np.flatnonzero(visits):
            at = here[(name[here] != name[i]) & (100 * np.minimum(size[here], size[i]) >= percent * np.maximum(size[here], size[i]))]
            apart = np.bitwise_count(sketch[at] ^ sketch[i]).sum(1, dtype=np.int64)
            near = apart * (100 + percent) <= (100 - percent) * (size[at] + size[i])
            at, apart = at[near], apart[near]
            if len(at):
                nearest.append((doc[i], doc[at[np.argmin(apart)]]))
                every.append(np.stack([np.full(len(at), doc[i]), doc[at]], 1))
        again = sum(map(len, every)) > most * len(doc)
        pairs = np.array(nearest, np.int64).reshape(-1, 2) if again or not every else np.concatenate(every)
        pairs = np.unique(np.sort(pairs, axis=1), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1]), "again": pa.array(np.full(len(pairs), again))})

    return run


def torn_groups(many: DataFrame, found: DataFrame) -> DataFrame:
    """Members of frequent cells that span components: ``g, band, a, n, c`` (the component) and ``main`` (the group's largest one).

    Cells of like documents have nearly the same members; those with the same first member form one group.
    """
    named = many.join(found.withColumnRenamed("node", "a"), "a", "left").select("key", "a", "n", "band", F.coalesce("component", "a").alias("c"))
    named = X.stored(named, "named")
    cells = named.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min("a").alias("g")).where("low < high").select("key", "g")
    members = X.stored(named.join(cells, "key").select("g", "band", "a", "n", "c").distinct(), "torn")
    main = members.groupBy("g", "band", "c").agg(F.count("*").alias("m")).groupBy("g", "band").agg(F.max(F.struct("m", "c")).alias("top"), F.sum("m").alias("docs"))
    return members.join(main.select("g", "band", F.col("top.c").alias("main"), "docs"), ["g", "band"])


def across(many: DataFrame, found: DataFrame, texts: DataFrame, width: int, percent: int, most: float) -> DataFrame:
    """Pairs (``a``, ``b``) that share a frequent cell, lie in different components and are near by their sketches.

    A group's members are dealt out over blocks; those outside its largest component visit every block.
    ``again`` tells of groups that have given the nearest pairs only.
    """
    members = torn_groups(many, found)
    sketches = texts.withColumnRenamed("doc_id", "a").join(members.select("a", "band").distinct(), "a").select("a", "band", "text")
    sketches = sketches.mapInArrow(_bit_sketches(width), "a long, band int, sketch binary").dropDuplicates(["a", "band"])
    placed = members.join(sketches, ["a", "band"]).withColumn("blocks", F.expr(f"cast(ceil(docs / {BLOCK}) as int)"))
    resident = placed.withColumn("block", F.expr("cast(pmod(xxhash64(a), blocks) as int)")).withColumn("visits", F.lit(False))
    visitor = placed.where("c <> main").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("visits", F.lit(True))
    columns = ["g", "band", "block", "a", "n", "c", "visits", "sketch"]
    return resident.select(*columns).unionAll(visitor.select(*columns)).groupBy("g", "band", "block").applyInArrow(_apart(percent, most), "a long, b long, again boolean")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """``doc_id, n_shingles, class_id`` (smallest id with the same set) and ``component_id`` (smallest id reachable by links)."""
    parts = X.partitions(docs.sparkSession)
    buckets = X.bucketed(docs, "doc_id", "text", per_part=BUCKETS)
    counts = X.answer(X.ask(buckets, lambda t: _Bucket(t, width, percent, parts).question()), _count)

    def emit(table, replies):
        return _emit(_Bucket(table, width, percent, parts), table, replies, percent)

    rows = X.stored(X.with_answers(buckets, counts, emit, _KINDS, BUCKETS), "sketches")
    texts = rows.where(F.col("kind") == TEXT).select("doc_id", "text")
    few = rows.where(F.col("kind") == FEW).select("part", "blob").repartitionById(parts, "part").mapInArrow(_pairs(percent), "a long, b long")
    many = rows.where(F.col("kind") == MANY).select("key", F.col("doc_id").alias("a"), "n", F.col("part").alias("band"))
    fits = f"100 * least(n, m) >= {percent} * greatest(n, m)"
    heads = many.groupBy("key").agg(F.min(F.struct("a", "n")).alias("head"))
    to_head = many.join(heads, "key").selectExpr("a", "head.a AS b", "n", "head.n AS m").where(f"a <> b AND {fits}").select("a", "b")
    links = X.stored(verified(few.unionAll(to_head).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), texts, width, percent), "links")
    found = X.stored(components(links), "components")
    for most in MOST_PAIRS:
        near = X.stored(across(many, found, texts, width, percent, most), "near")
        more = X.stored(verified(near.select("a", "b").distinct(), texts, width, percent), "links")
        if more.take(1):
            links = links.unionAll(more)
            found = X.stored(components(links), "components")
        if not near.where("again").take(1):
            break
    every = rows.where(F.col("kind") == DOC).select("doc_id", F.col("n").alias("n_shingles"), "class_id")
    out = every.join(found.withColumnRenamed("node", "class_id"), "class_id", "left")
    return out.select("doc_id", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id"))
