"""Near duplicates: a join of documents by the Jaccard similarity of their word n-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, discard, materialize, small_batches, stored, tidy

#: Coordinates of a document's point: n-grams are hashed into so many groups and counted.
GROUPS = 512
#: Documents from which common n-grams and hot keys are learned at most (about), and how many of them make one common or hot. So what reaches the driver or is broadcast is bounded by the n-grams of so many documents over COMMON_DOCS.
SAMPLE_DOCS, COMMON_DOCS = 5000, 10
#: Points in a leaf of the tree, and children of a node.
LEAF, FANOUT = 32, 8
#: Documents and n-grams in a tile of a group, and partners of a document in one part.
TILE, TILE_GRAMS, STAR = 4096, 2_000_000, 2000
#: Sets that a task remembers, so as to give equal ones their keys once.
SEEN = 200_000
MILLION = 1_000_000


def mixed(x, salt: int):
    import numpy as np

    x = (x ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts, n: int):
    """(hashes, ends) of an Arrow array of texts: each text's sorted distinct 64-bit hashes of its n-grams of words, A-Z in lower case; of all its words, if they are fewer."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    import xxhash

    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = words.flatten().dictionary_encode()
    own = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    of = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in own), "uint64", len(own))
    number, text = coded.indices.to_numpy(), np.repeat(np.arange(len(texts)), words.value_lengths().to_numpy())
    if b"" in own:  # blanks at a text's ends
        there = number != own.index(b"")
        number, text = number[there], text[there]
    w, count = of[number], np.bincount(text, minlength=len(texts))
    upto = np.cumsum(count)
    size = np.minimum(n, count)
    # an n-gram starts wherever enough words follow; a shorter text has one
    start = np.nonzero(np.arange(len(w)) + size[text] <= upto[text])[0]
    k = size[text[start]]
    h = k.astype("uint64")
    for i in range(n):
        at = np.minimum(start + i, len(w) - 1)
        step = (h + w[at]) * np.uint64(0x5851F42D4C957F2D)
        step ^= step >> np.uint64(29)
        h = step if (k > i).all() else np.where(k > i, step, h)
    ends = np.cumsum(count - size + (count > 0))
    for a, b in zip([0, *ends.tolist()], ends.tolist()):
        h[a:b].sort()
    new = np.append(True, h[1:] != h[:-1])[: len(h)]
    new[np.append(0, ends[:-1])[np.append(0, ends[:-1]) < len(h)]] = True
    return h[new], np.cumsum(np.append(0, new))[ends] if len(h) else ends


def sums_by(values, ends):
    """Sums, modulo 2**64, of the runs of values that end at ends."""
    import numpy as np

    upto = np.append(np.uint64(0), np.cumsum(values, dtype="uint64"))
    return upto[ends] - upto[np.append(0, ends[:-1])]


def nodes_of(h, ends):
    """A number for each set, independent of order."""
    return sums_by(mixed(h, 0x2545F4914F6CDD1D), ends).astype("int64")


class Slabs:
    """Keys of which any two documents that link share one.

    Two sets of n and m n-grams with num / den * union <= intersection differ in at most
    (den - num) (n + m) / (den + num) elements. Elements are dealt by hash to more slabs
    than that, so some slabs hold the same elements in both. Sizes fall into classes
    such that partners are in the same or the next class; a document has the slabs of its
    own class and of the next. Common n-grams stay out, so that what many documents have
    brings none together; slabs left empty make no key, and there are `spare` more slabs
    than differences, so that it takes over `spare` empty ones to miss a partner. A
    document with so many of them also has the keys of slabs of all n-grams.
    """

    def __init__(self, num: int, den: int, common):
        self.num, self.den, self.common, self.starts = num, den, common, [1]

    def labels(self, sizes):
        """The class of each size."""
        import numpy as np

        while self.starts[-1] <= sizes.max(initial=0):
            self.starts.append(self.starts[-1] * self.den // self.num + 1)
        return np.searchsorted(np.array(self.starts), sizes, side="right") - 1

    def counts(self, labels):
        """(slabs, spare ones) of each class."""
        import numpy as np

        while len(self.starts) <= labels.max(initial=0) + 1:
            self.starts.append(self.starts[-1] * self.den // self.num + 1)
        most = (self.den - self.num) * 2 * (np.array(self.starts)[labels + 1] - 1) // (self.den + self.num)
        spare = np.where(most > 0, most // 20 + 1, 0)
        return most + 1 + spare, spare

    def _slabs(self, h, of, label, n, spare, kind):
        """(keys, the documents they are of, the documents that need more keys) for sets whose elements h are of documents."""
        import numpy as np

        first = np.cumsum(n) - n
        place = mixed(h, 0x9FB21C651E98DF25)
        slab = first[of] + (((place >> np.uint64(32)) * n.astype("uint64")[of]) >> np.uint64(32)).astype("int64")
        total = np.zeros(int(n.sum()), "uint64")
        np.add.at(total, slab, place * np.uint64(0xA0761D6478BD642F))
        full = np.bincount(slab, minlength=len(total)) > 0
        owner = np.repeat(np.arange(len(n)), n)
        index = (np.arange(len(total)) - first[owner]).astype("uint64")
        key = mixed(mixed(total + index * np.uint64(0xE7037ED1A0B428DB), 0x589965CC75374CC3) + (label[owner] * 4 + kind).astype("uint64"), 0x8EBC6AF09C88C6E3)
        short = n - np.bincount(owner[full], minlength=len(n)) > spare
        keep = full | short[owner] if kind else full
        return key[keep], owner[keep], short

    def keys(self, h, ends):
        """(keys, the number of each one's set) of sets that aren't empty."""
        import numpy as np

        sizes = np.diff(np.append(0, ends))
        of = np.repeat(np.arange(len(sizes)), sizes)
        rare = np.ones(len(h), bool)
        if len(self.common):
            rare = self.common[np.minimum(np.searchsorted(self.common, h), len(self.common) - 1)] != h
        own, keys, sets = self.labels(sizes), [], []
        for label in (own, own + 1):
            n, spare = self.counts(label)
            key, doc, short = self._slabs(h[rare], of[rare], label, n, spare, 0)
            keys.append(key)
            sets.append(doc)
            if short.any():  # too few n-grams that aren't common
                number, part = np.cumsum(short) - 1, short[of]
                key, doc, _ = self._slabs(h[part], number[of[part]], label[short], n[short], spare[short], 1)
                keys.append(key)
                sets.append(np.nonzero(short)[0][doc])
        return np.concatenate(keys), np.concatenate(sets)


def _sample(n):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in byte_slices(batch, "_text"):
                h, count = np.unique(shingle_sets(part.column(0), n)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view("int64")), pa.array(count.astype("int64"))], names=["h", "n"])

    return tidy(run)


def _sets(n, num, den, common):
    def run(batches):
        """For each text its set's size and number, and the keys if the task hasn't given them for this set."""
        import numpy as np
        import pyarrow as pa

        slabs, seen = Slabs(num, den, np.frombuffer(common, "uint64")), set()
        for batch in batches:
            for part in byte_slices(batch, "_text"):
                h, ends = shingle_sets(part.column(part.schema.names.index("_text")), n)
                sizes, node = np.diff(np.append(0, ends)), nodes_of(h, ends)
                if len(seen) > SEEN:
                    seen.clear()
                fresh = np.zeros(len(sizes), bool)
                for i in np.nonzero(sizes)[0].tolist():
                    if (x := int(node[i])) not in seen:
                        seen.add(x)
                        fresh[i] = True
                key, doc = slabs.keys(h[np.repeat(fresh, sizes)], np.cumsum(sizes[fresh])) if fresh.any() else (np.zeros(0, "uint64"), np.zeros(0, "int64"))
                order = np.argsort(doc, kind="stable")
                count = np.zeros(len(sizes), "int64")
                count[fresh] = np.bincount(doc, minlength=int(fresh.sum()))
                keys = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.array(key[order].view("int64")))
                yield pa.RecordBatch.from_arrays([part.column(part.schema.names.index("_id")), pa.array(sizes, pa.int64()), pa.array(node, mask=sizes == 0), keys], names=["id", "n_shingles", "node", "keys"])

    return tidy(run)


def _buckets(batches):
    """From rows in order of key and node: those whose key several nodes have, and all rows of hot keys, without repeats. A key's last row is carried on."""
    import numpy as np
    import pyarrow as pa

    carried = None  # the last row, and whether it is out
    for batch in batches:
        if not batch.num_rows:
            continue
        key, node, hot = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if carried is not None:
            key, node, hot = np.append(carried[0], key), np.append(carried[1], node), np.append(carried[2], hot)
        same_key = key[1:] == key[:-1]
        fresh = np.append(True, ~same_key | (node[1:] != node[:-1]))
        group = np.cumsum(np.append(0, ~same_key))
        several = np.bincount(group[fresh])[group] > 1
        if carried is not None and carried[3]:
            several |= group == 0  # its key has several, of which some are out
        keep = fresh & (several | hot)
        if carried is not None and carried[3]:
            keep[0] = False
        # a lone node waits for what the next batch brings
        carried = key[-1], node[-1], hot[-1], bool(several[-1] or hot[-1])
        yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(node[keep])], names=["key", "node"])


def _arrays(n):
    def run(batches):
        """The columns given, with the sorted hashes of the text's n-grams and its point (a byte a count, or four) in place of the text; only rows whose text has the wanted set."""
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in byte_slices(batch, "_text"):
                h, ends = shingle_sets(part.column(part.schema.names.index("_text")), n)
                good = nodes_of(h, ends) == part.column(part.schema.names.index("node")).to_numpy()
                at = np.append(0, ends * 8).astype("int32")
                data = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(h.tobytes())])
                points = [p.astype("uint8" if p.max() < 256 else "<u4").tobytes() for p in points_of(h, ends)]
                names = [c for c in part.schema.names if c != "_text"]
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.names.index(c)) for c in names], data, pa.array(points, pa.binary())], names=[*names, "data", "point"]).filter(pa.array(good))

    return tidy(run)


def hash_sets(column) -> list:
    """The arrays of hashes in a column of binary values."""
    import numpy as np

    return [np.frombuffer(x.as_buffer(), "uint64") for x in column]


def overlap(x, y) -> int:
    """The number of common elements of two sorted arrays of distinct elements."""
    import numpy as np

    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def links(n: int, m: int, both: int, num: int, den: int) -> bool:
    return den * both >= num * (n + m - both)


def _verify(num, den):
    def run(batches):
        """From rows in order of to, part and own (first): the partners whose exact similarity suffices."""
        import pyarrow as pa

        at, own = None, None
        for batch in batches:
            a, b = [], []
            col = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            keys = zip(*[col[c].to_numpy(zero_copy_only=False).tolist() for c in ("to", "part", "node", "own")])
            for (to, part, node, is_own), h in zip(keys, hash_sets(col["data"])):
                if is_own:
                    at, own = (to, part), h.copy()
                elif at == (to, part) and links(len(own), len(h), overlap(own, h), num, den):
                    a.append(to)
                    b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return tidy(run)


class Tree:
    """An R-tree over count vectors, packed from the top down; each node knows its box and its least size."""

    def __init__(self, points):
        import numpy as np

        self.np, self.points = np, points
        self.sizes = points.sum(axis=1).astype("int64")
        self.root = self._pack(np.arange(len(points)))

    def _pack(self, ids):
        np = self.np
        p = self.points[ids]
        node = {"ids": ids, "hi": p.max(axis=0), "least": int(self.sizes[ids].min()), "below": None}
        if len(ids) > LEAF:
            # tiles along the coordinate of the largest spread, the size included
            spread = np.append(p.var(axis=0), self.sizes[ids].var())
            d = int(spread.argmax())
            order = np.argsort(self.sizes[ids] if d == p.shape[1] else p[:, d], kind="stable")
            node["below"] = [self._pack(ids[x]) for x in np.array_split(order, min(FANOUT, -(-len(ids) // LEAF)))]
        return node


def surviving_pairs(x: Tree, y: Tree, x_comp, y_comp, num: int, den: int, x_done=None, y_done=None):
    """(i, j): arrays of pairs of points of two trees, or of one with itself, that are in different components and whose bound on the overlap allows a link.

    The components may change while the pairs are taken. Pairs of two points that are done are left out.
    """
    import numpy as np

    stack = [(x.root, y.root)]
    while stack:
        a, b = stack.pop()
        ca, cb = x_comp[a["ids"]], y_comp[b["ids"]]
        if ca.min() == ca.max() == cb.min() == cb.max() or x_done is not None and x_done[a["ids"]].all() and y_done[b["ids"]].all():
            continue
        # the overlap is at most the summed minima, and a link needs num (n + m) / (num + den) of it
        if (num + den) * int(np.minimum(a["hi"], b["hi"]).sum()) < num * (a["least"] + b["least"]):
            continue
        if a["below"] is None and b["below"] is None:
            i, j = a["ids"], b["ids"]
            over = np.minimum(x.points[i][:, None, :], y.points[j][None, :, :]).sum(axis=2).astype("int64")
            good = ((num + den) * over >= num * (x.sizes[i][:, None] + y.sizes[j][None, :])) & (ca[:, None] != cb[None, :])
            if x is y and a is b:
                good = np.triu(good, 1)
            k, m = np.nonzero(good)
            yield i[k], j[m]
        elif x is y and a is b:
            stack += [(a["below"][k], a["below"][m]) for k in range(len(a["below"])) for m in range(k, len(a["below"]))]
        elif b["below"] is None or a["below"] is not None and len(a["ids"]) >= len(b["ids"]):
            stack += [(k, b) for k in a["below"]]
        else:
            stack += [(a, k) for k in b["below"]]


def points_of(h, ends):
    """The counts of each set's n-grams in GROUPS groups."""
    import numpy as np

    of = np.repeat(np.arange(len(ends)), np.diff(np.append(0, ends)))
    return np.bincount(of * GROUPS + (mixed(h, 0x1D8E4E27C47D124F) % np.uint64(GROUPS)).astype("int64"), minlength=len(ends) * GROUPS).reshape(-1, GROUPS)


class Tile:
    """Rows (node, component, tile, data) of one tile of a group, or of two: a tree of the points of each."""

    def __init__(self, rows: list, points):
        import numpy as np

        points = points.astype("uint8" if points.max() < 256 else "uint16" if points.max() < 65536 else "uint32")
        self.rows, comp = rows, np.array([r[1] for r in rows])
        self.sides = [np.array([i for i, r in enumerate(rows) if r[2] == t]) for t in sorted({r[2] for r in rows})]
        self.trees, self.comps = [Tree(points[s]) for s in self.sides], [comp[s] for s in self.sides]

    def pairs(self, num, den, done=(None,)):
        return surviving_pairs(self.trees[0], self.trees[-1], self.comps[0], self.comps[-1], num, den, done[0], done[-1])


def with_survivors(rows: list, num: int, den: int) -> list[int]:
    """The nodes of rows (node, component, tile, point) that the tree can't rule out to link with another component."""
    import numpy as np

    tile = Tile(rows, np.stack([np.frombuffer(r[3], "uint8" if len(r[3]) == GROUPS else "<u4") for r in rows]))
    done = [np.zeros(len(s), bool) for s in tile.sides]
    for i, j in tile.pairs(num, den, done):
        done[0][i] = True
        done[-1][j] = True
    return [rows[i][0] for s, d in zip(tile.sides, done) for i in s[d]]


def links_in(rows: list, num: int, den: int, contract: bool) -> list[tuple[int, int]]:
    """Links among rows (node, component, tile, hashes): survivors of the tree are verified at once.

    With contract, linked components become one, so that there is a link for each join
    of components at most; else all links come.
    """
    import numpy as np

    sets = [np.frombuffer(r[3], "uint64") for r in rows]
    tile, found = Tile(rows, np.concatenate([points_of(h, np.array([len(h)])) for h in sets])), []
    (x, y), (cx, cy) = (tile.sides[0], tile.sides[-1]), (tile.comps[0], tile.comps[-1])
    for many_i, many_j in tile.pairs(num, den):
        for i, j in zip(many_i.tolist(), many_j.tolist()):
            a, b = cx[i], cy[j]
            if a == b:
                continue
            g, h = sets[x[i]], sets[y[j]]
            if links(len(g), len(h), overlap(g, h), num, den):
                m, k = rows[x[i]][0], rows[y[j]][0]
                found.append((min(m, k), max(m, k)))
                if contract:
                    for c in tile.comps:
                        c[c == b] = a
    return found


def _by_tile(search, names):
    """search(group, rows) for the rows of each group, i and j, which come in order; its results are pairs of longs."""

    def run(batches):
        import pyarrow as pa

        at, rows = None, {}

        def out():
            found = search(at[0], list(rows.values())) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=names)

        for batch in batches:
            col = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            keys = zip(*[col[c].to_numpy().tolist() for c in ("group", "i", "j", "node", "comp", "tile")])
            for (g, i, j, node, comp, tile), data in zip(keys, col["data"]):
                if at != (g, i, j):
                    if rows:
                        yield out()
                    at, rows = (g, i, j), {}
                if node not in rows:
                    rows[node] = node, comp, tile, data.as_py()
        if rows:
            yield out()

    return tidy(run)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): connected components of edges(a, b) by alternating large and small stars; each round is written out."""
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    before = None
    while True:
        # large star: larger neighbours go to the least neighbour
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its smaller neighbours go to the least of these
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x")).select("x.u", F.col("x.m").alias("v")).where("u <> v").distinct()
        e = materialize(small, name)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


class Candidates:
    """Sets of docs in groups of which any two that link share one.

    Equal sets become one class (node). Classes get keys of which linked ones share one
    (see Slabs). A key's members go to the group of that member which shares most keys
    with others: of near copies, one with few edits. So a class is in a group for each
    such member that it meets, not for each key.
    """

    def __init__(self, docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str):
        self.n, self.num, self.den = n, num, den
        spark = docs.sparkSession
        small_batches(spark)
        self.parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.given = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        id_type = self.given.schema["_id"].dataType.simpleString()
        share = min(MILLION, MILLION * SAMPLE_DOCS // max(1, docs.count()))
        sample = self.given.where(F.pmod(F.xxhash64("_id", "_text"), F.lit(MILLION)) < share).select("_text")
        rows = sample.mapInArrow(_sample(n), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_DOCS).select("h").toPandas()
        whole, path = stored(self.given.mapInArrow(_sets(n, num, den, _sorted_bytes(rows["h"])), f"id {id_type}, n_shingles long, node long, keys array<long>"), "sets-and-keys")
        self.sets = materialize(whole.select("id", "n_shingles", "node"), "sets")
        self.classes = materialize(self.sets.where("node IS NOT NULL AND id IS NOT NULL").groupBy("node").agg(F.min("id").alias("id"), F.first("n_shingles").alias("n_shingles")), "classes")
        keys = whole.where("id IS NOT NULL").select(F.explode("keys").alias("key"), "node")
        # a key of many sampled sets may hold any share of all: its rows are dealt to all tasks
        hot = whole.where(F.pmod(F.xxhash64("node"), F.lit(MILLION)) < share).select(F.explode("keys").alias("key")).groupBy("key").count().where(F.col("count") >= COMMON_DOCS)
        hot = materialize(hot.select("key", F.lit(True).alias("hot")), "hot-keys")
        keys = keys.join(F.broadcast(hot), "key", "left").select("key", "node", F.coalesce("hot", F.lit(False)).alias("hot"))
        keys = keys.repartition(self.parts, "key", F.when(F.col("hot"), F.col("node"))).sortWithinPartitions("key", "node")
        shared = materialize(keys.mapInArrow(tidy(_buckets), "key long, node long"), "shared-keys")
        discard(spark, path)
        degree = shared.groupBy("node").agg(F.count("*").alias("degree"))
        # keys with the same members are one
        firsts = shared.join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", "node")).alias("m"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("h1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("h2"))
        firsts = firsts.where("n > 1").groupBy("n", "h1", "h2", "m").agg(F.min("key").alias("key"), F.count("*").alias("keys"))
        firsts = firsts.select("key", "keys", F.col("m.node").alias("group"), F.col("m.degree").alias("degree"))
        #: A row for each group and member, the group's first included, with the number of keys that brought it there.
        self.members = materialize(shared.join(firsts, "key").groupBy("group", "node").agg(F.sum("keys").alias("keys"), F.first("degree").alias("degree")), "members")

    def fetched(self, targets: DataFrame | None = None) -> DataFrame:
        """node, data, point, targets: the n-grams of all members. Their texts are read again, once; targets(node, targets) are carried along."""
        wanted = self.members.select("node").distinct()
        wanted = wanted.join(targets, "node", "left") if targets is not None else wanted
        wanted = materialize(wanted.join(self.classes.select("node", "id"), "node"), "wanted")
        # sorted at every size, so that plans are alike
        texts = self.given.where("_text IS NOT NULL").join(wanted.hint("merge"), F.col("id") == F.col("_id")).drop("id", "_id")
        return materialize(texts.mapInArrow(_arrays(self.n), texts.drop("_text").schema.add("data", "binary").add("point", "binary")), "arrays")

    def starred(self) -> tuple[DataFrame, DataFrame]:
        """(arrays, links): the members' n-grams, and the links among each member and the first of the group that most of its keys lead to.

        Each is sent to its first, in parts of about STAR members, and compared there as
        the sorted rows stream by.
        """
        best = self.members.where(F.col("group") != F.col("node")).groupBy("node").agg(F.max(F.struct("keys", "degree", "group")).alias("m"))
        stars = materialize(best.select(F.col("m.group").alias("a"), F.col("node").alias("b")), "stars")
        degree = materialize(stars.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts")), "degrees")
        part = F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int")
        to = stars.join(degree.where("parts > 1"), "a", "left").select(F.col("b").alias("node"), F.struct(F.col("a").alias("to"), F.array(part).alias("parts"), F.lit(False).alias("own")).alias("t"))
        own = degree.select(F.col("a").alias("node"), F.struct(F.col("a").alias("to"), F.sequence(F.lit(0), F.col("parts") - 1).alias("parts"), F.lit(True).alias("own")).alias("t"))
        # two at most: as a member, and as a first
        arrays = self.fetched(to.union(own).groupBy("node").agg(F.collect_list("t").alias("targets")))
        rows = arrays.select("node", "data", F.explode("targets").alias("t")).select("t.to", F.explode("t.parts").alias("part"), "t.own", "node", "data")
        rows = rows.repartition(self.parts, "to", "part").sortWithinPartitions("to", "part", F.desc("own"))
        return arrays, materialize(rows.mapInArrow(_verify(self.num, self.den), "a long, b long").distinct(), "links")

    def by_tile(self, members: DataFrame, data: DataFrame, search, names: str) -> DataFrame:
        """What search finds in each tile of the groups of members(group, node, comp, n_shingles), of whose nodes data(node, data) has one row or more.

        A tile has a bounded number of documents and n-grams; each is searched with itself
        and each two against each other, a task for each.
        """
        tiles = members.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("n_shingles") / TILE_GRAMS)).cast("int").alias("tiles"))
        tiles = materialize(tiles.where("tiles > 1"), "tiles")
        own = F.coalesce("tiles", F.lit(1))
        rows = members.join(tiles, "group", "left").join(data, "node").withColumn("tile", F.pmod(F.xxhash64("node"), own).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), own - 1)))
        rows = rows.select("group", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "node", "comp", "tile", "data")
        rows = rows.repartition(self.parts, "group", "i", "j").sortWithinPartitions("group", "i", "j", "node")
        return rows.mapInArrow(_by_tile(search, names.split()), ", ".join(f"{x} long" for x in names.split())).distinct()

    def searched(self, members: DataFrame, arrays: DataFrame, contract: bool) -> DataFrame:
        """The links in the groups of members(group, node, comp) between different comps; with contract, as many as join the components that link.

        First trees of points tell which members may link at all; only their n-grams are
        then sent to their tiles, where trees find the pairs to verify.
        """
        num, den = self.num, self.den
        sized = materialize(members.join(self.classes, "node"), "open")
        points = arrays.select("node", F.col("point").alias("data"))
        left = self.by_tile(sized, points, lambda group, rows: [(group, x) for x in with_survivors(rows, num, den)], "group node")
        sized = materialize(sized.join(left, ["group", "node"], "left_semi"), "survivors")
        return self.by_tile(sized, arrays.select("node", "data"), lambda group, rows: links_in(rows, num, den, contract), "a b")


def near_duplicates(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id, class_id: a row for each row of docs.

    Words are what lies between blanks (space, U+0009 to U+000D), A-Z in lower case; a
    document's set is its distinct n-grams of words, or all its words as one if they are
    fewer. Two documents link if den * intersection >= num * union. component_id is the
    smallest id reachable by links, class_id the smallest with an equal set. For the
    links themselves see similar_pairs.

    Candidates are found as Candidates says. Each is first held exactly against the first
    of the group that most of its keys lead to; in groups that then hold several
    components, R-trees over the sets' count vectors rule out pairs whose summed minima
    bound the overlap too low, and survivors are verified exactly where they are found,
    until their components are one. So near copies cost a comparison or two for
    each member, and no link between components is lost. n-grams are told apart by
    64-bit hashes.

    Null and empty texts have no n-grams and are their own component. Rows of one id may
    have different texts; null ids take no part and have a null component. Repeated rows
    are rows of the result. An empty table gives an empty result.
    """
    c = Candidates(docs, n, num, den, id_col, text_col)
    arrays, found = c.starred()
    roots = components(found)

    joined = c.members.select("group", "node").join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    mixed_groups = joined.groupBy("group").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("group")
    more = materialize(c.searched(joined.join(mixed_groups, "group"), arrays, contract=True), "links")
    # contract by what is known, then by the rest
    final = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)) if not more.isEmpty() else roots

    named = c.classes.join(final, "node", "left").withColumn("root", F.coalesce("root", "node"))
    label = named.groupBy("root").agg(F.min("id").alias("component_id"))
    known = materialize(named.join(label, "root").select("node", F.col("id").alias("class_id"), "component_id"), "known")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return c.sets.join(known, "node", "left").select(F.col("id").alias(id_col), "n_shingles", own.alias("component_id"), F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id")).alias("class_id"))


def similar_pairs(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(links, members): all links a < b between the representatives of different sets, and class_id and id_col for each document with n-grams.

    As near_duplicates, but without contraction, so that no link is left out; of documents
    that all link there are as many as pairs of their different sets.
    """
    c = Candidates(docs, n, num, den, id_col, text_col)
    found = materialize(c.searched(c.members.select("group", "node", F.col("node").alias("comp")), c.fetched(), contract=False), "links")
    a, b = (c.classes.select(F.col("node").alias(x), F.col("id").alias(f"id_{x}")) for x in "ab")
    named = found.join(a, "a").join(b, "b").select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))
    members = c.sets.where("id IS NOT NULL").select("node", F.col("id").alias(id_col)).distinct().join(c.classes.select("node", F.col("id").alias("class_id")), "node")
    return named, members.select("class_id", id_col)


def _sorted_bytes(column) -> bytes:
    import numpy as np

    return np.sort(column.to_numpy("int64").view("uint64")).tobytes()


def op4_ngram_jaccard(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs.select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 3], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (
  WITH RECURSIVE reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN e ON r.other = e.a)
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id)
"""
