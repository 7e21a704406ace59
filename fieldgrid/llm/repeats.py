"""Removal of long repeated substrings by enhanced suffix arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_slices, discard, materialize, new_folder, small_batches, stored, tidy
from .rolling import hashes_of, prefix_sums

#: Starts that are hashed at once, and starts of one run at most.
CHUNK, RUN = 1 << 21, 8192
#: Bytes of text for which one suffix array is built, about; a group with more is split by the strings' own hashes.
BLOCK, HOT = 1 << 19, 1 << 21


def sliding_least(x, width: int):
    """The least of each `width` neighbours."""
    import numpy as np

    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    rows = -(-len(x) // width)
    full = np.full(rows * width, np.iinfo(x.dtype).max, x.dtype)
    full[: len(x)] = x
    full = full.reshape(rows, width)
    ahead = np.minimum.accumulate(full, axis=1).reshape(-1)
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def seed_of(length: int) -> int:
    """Bytes of the substring whose hash groups the strings that have it. A longer one makes more runs, but fewer whose groups only share a line or a phrase."""
    return max(1, length // 3)


def runs_of(data, offsets, length: int):
    """(first start, number of starts, least seed hash, times that it occurs) of the runs of strings of `length` bytes with one least seed hash.

    Equal strings have equal least hashes wherever they stand, so two equal strings are
    in runs of one hash. No string crosses a text's end. data holds texts end to end.
    """
    import numpy as np

    width = seed_of(length)
    for lo in range(0, max(1, len(data) - length + 1), CHUNK):
        own = data[lo : lo + CHUNK + length - 1]
        if len(own) < length:
            return
        n = len(own) - length + 1
        at = np.arange(len(own) - width + 1)
        seeds = hashes_of(prefix_sums(own), at, at + width)
        least = sliding_least(seeds, length - width + 1)
        ends = offsets[1:] - lo
        text = np.searchsorted(ends, np.arange(n), side="right")
        whole = np.arange(n) + length <= ends[text]
        fresh = np.ones(n, bool)
        fresh[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
        firsts = np.flatnonzero(fresh)
        lasts = np.append(firsts[1:], n)
        held = np.concatenate([[0], np.cumsum(whole)])
        for a, b in zip(firsts.tolist(), lasts.tolist()):
            k = int(held[b] - held[a])  # the whole ones come first
            for i in range(a, a + k, RUN):
                m = min(RUN, a + k - i)
                yield lo + i, m, least[a], int(np.count_nonzero(seeds[i : i + m + length - width] == least[a]))


def _buffers(batch, name: str):
    """(bytes of all texts, their offsets in it) of a column of texts."""
    import numpy as np

    column = batch.column(batch.schema.names.index(name))
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _marks(length: int):
    """The runs of each text: h, the least hash; c, a hash of the run's bytes; row, pos, n; seeds, how often the least one occurs."""

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in byte_slices(batch, "text"):
                data, offsets = _buffers(part, "text")
                rows, raw = part.column(part.schema.names.index("_row")).to_numpy(), data.tobytes()
                found = list(runs_of(data, offsets, length))
                if not found:
                    continue
                start, n, h, seeds = (np.array(x) for x in zip(*found))
                c = [int.from_bytes(hashlib.blake2b(raw[a : a + m + length - 1], digest_size=8).digest(), "little", signed=True) for a, m in zip(start.tolist(), n.tolist())]
                text = np.searchsorted(offsets, start, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.astype(np.uint64).view(np.int64)), pa.array(c, pa.int64()), pa.array(rows[text]), pa.array(start - offsets[text]), pa.array(n.astype(np.int32)), pa.array(seeds.astype(np.int32))],
                    ["h", "c", "_row", "pos", "n", "seeds"],
                )

    return tidy(run)


def _contexts(length: int):
    """The bytes of the runs that a text's list names."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            cols = [batch.column(batch.schema.names.index(x)) for x in ("text", "wanted")]
            out = []
            for text, wanted in zip(*cols):
                raw = text.as_buffer().to_pybytes()
                out += [(w["h"], w["c"], w["n"], w["times"], w["hot"], raw[w["pos"] : w["pos"] + w["n"] + length - 1]) for w in wanted.as_py()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()))], ["h", "c", "n", "times", "hot", "bytes"])

    return tidy(run)


class SuffixArray:
    """The suffixes of several strings, from chosen starts, in order, and what neighbours have in common.

    Ranks of all positions by their first 7, 14, 28... bytes are made by doubling; a
    string's end is less than any byte, and no suffix goes beyond its string.
    """

    def __init__(self, strings: list[bytes], counts: list[int]):
        import numpy as np

        sizes = np.array([len(s) for s in strings], np.int64)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        n = int(self.ends[-1])
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        self.owner = np.repeat(np.arange(len(strings)), sizes)
        self.rest = self.ends[self.owner] - np.arange(n)
        key, symbols = np.zeros(n, np.int64), self.data.astype(np.int64) + 1
        for i in range(7):
            key <<= 9
            key[: n - i] |= np.where(self.rest[: n - i] > i, symbols[i:], 0)
        self.levels, width, most = [], 7, int(sizes.max())
        rank, tied = np.zeros(n, np.int64), np.arange(n)
        while True:
            # a rank is the place of the first of its equals, so only what is tied is sorted again
            order = np.argsort(key, kind="stable")
            tied, key = tied[order], key[order]
            number = np.arange(len(tied))
            before = rank[tied]
            fresh = np.concatenate([[True], key[1:] != key[:-1]])
            group = np.concatenate([[True], before[1:] != before[:-1]])
            own = np.maximum.accumulate(np.where(fresh, number, 0))
            rank[tied] = before + own - np.maximum.accumulate(np.where(group, number, 0))
            self.levels.append((width, rank.astype(np.int32)))
            alone = fresh & np.append(fresh[1:], True)
            tied = tied[~alone]
            if width >= most or not len(tied):
                break
            after = np.zeros(len(tied), np.int64)
            inside = np.flatnonzero(self.rest[tied] > width)
            after[inside] = rank[tied[inside] + width] + 1
            key = rank[tied] * (n + 2) + after
            width *= 2
        chosen = np.concatenate([np.arange(b, b + c) for b, c in zip(self.begins, counts)])
        self.order = chosen[np.argsort(rank[chosen], kind="stable")]
        self.common = self._common(self.order[:-1], self.order[1:])

    def _common(self, a, b):
        """The bytes that the suffixes at a and b have in common at their beginnings."""
        import numpy as np

        most, got = np.minimum(self.rest[a], self.rest[b]), np.zeros(len(a), np.int64)
        for width, rank in reversed(self.levels):
            i = np.flatnonzero(got < most)
            same = i[rank[a[i] + got[i]] == rank[b[i] + got[i]]]
            got[same] += width
        for _ in range(6):
            i = np.flatnonzero(got < most)
            same = i[self.data[a[i] + got[i]] == self.data[b[i] + got[i]]]
            if not len(same):
                break
            got[same] += 1
        return np.minimum(got, most)

    def maximal_repeats(self, least: int):
        """(length, first, last) of the intervals of the order whose suffixes have `least` bytes or more in common and differ in the byte before.

        Intervals are those of the tree of common prefixes, found by a scan with a stack.
        A suffix at its string's beginning differs from all others. Stretches whose
        suffixes all follow the same byte have no such interval and are not scanned.
        """
        import numpy as np

        if not len(self.common):
            return
        at_begin = self.order == self.begins[self.owner[self.order]]
        left = np.where(at_begin, -1, self.data[np.maximum(self.order - 1, 0)].astype(np.int64))
        high = self.common >= least
        edge = np.flatnonzero(np.diff(np.concatenate([[0], high.astype(np.int8), [0]])))
        for lo, hi in edge.reshape(-1, 2):  # suffixes lo..hi have neighbours in common
            own = left[lo : hi + 1]
            if own.min() == own.max() >= 0:
                continue
            yield from scan(self.common[lo:hi].tolist(), own.tolist(), int(lo))


def scan(common: list[int], left: list[int], base: int):
    """The left-diverse intervals of one stretch; left is -1 where it differs from all."""
    stack: list = []
    for i in range(1, len(left) + 1):
        now = common[i - 1] if i < len(left) else 0
        lb, state = i - 1, left[i - 1]
        while stack and stack[-1][0] > now:
            length, lb, own = stack.pop()
            state = own if own == state else -1
            if state == -1:
                yield length, base + lb, base + i - 1
        if now:
            if stack and stack[-1][0] == now:
                stack[-1][2] = stack[-1][2] if stack[-1][2] == state else -1
            else:
                stack.append([now, lb, state])


def _blocks(batches):
    """Lists of runs of whole groups, of BLOCK bytes or a group; batches come sorted by h."""
    held, size = [], 0
    for batch in batches:
        for r in zip(*[batch.column(batch.schema.names.index(x)).to_pylist() for x in ("h", "c", "n", "times", "bytes")]):
            if held and r[0] != held[-1][0] and size >= BLOCK:
                yield held
                held, size = [], 0
            held.append(r)
            size += len(r[4])
    if held:
        yield held


def _spans(length: int):
    """The bytes of each run that maximal repeats cover, as pairs of offsets."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for held in _blocks(batches):
            sa = SuffixArray([r[4] for r in held], [r[2] for r in held])
            reach = np.zeros(len(sa.order), np.int64)
            for size, lo, hi in sa.maximal_repeats(length):
                part = reach[lo : hi + 1]
                np.maximum(part, size, out=part)
            hit = np.flatnonzero(reach)
            change = np.zeros(len(sa.data) + 1, np.int64)
            np.add.at(change, sa.order[hit], 1)
            np.add.at(change, sa.order[hit] + reach[hit], -1)
            covered = np.cumsum(change)[:-1] > 0
            first = covered.copy()
            first[1:] &= ~covered[:-1] | (sa.owner[1:] != sa.owner[:-1])
            last = covered.copy()
            last[:-1] &= ~covered[1:] | (sa.owner[1:] != sa.owner[:-1])
            a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
            own, begin = np.unique(sa.owner[a], return_index=True)
            out = []
            for k, lo, hi in zip(own.tolist(), begin.tolist(), [*begin[1:].tolist(), len(a)]):
                if held[k][3] == 1:  # others have a copy, which is all that need be known
                    out.append((held[k][0], held[k][1], (np.stack([a[lo:hi], b[lo:hi]], 1) - sa.begins[k]).astype("<i4").tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))], ["h", "c", "spans"])

    return tidy(run)


def _windows(length: int):
    """Two hashes of each string of a run."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in byte_slices(batch, "bytes", 1 << 18):
                data, offsets = _buffers(part, "bytes")
                n = part.column(part.schema.names.index("n")).to_numpy().astype(np.int64)
                start = np.concatenate([np.arange(o, o + k) for o, k in zip(offsets, n)])
                sums, turned = prefix_sums(data), prefix_sums(data ^ np.uint8(0x5A))
                own = np.repeat(np.arange(len(n)), n)
                cols = {x: part.column(part.schema.names.index(x)).take(pa.array(own)) for x in ("h", "c", "times")}
                yield pa.RecordBatch.from_arrays(
                    [cols["h"], cols["c"], cols["times"], pa.array((start - offsets[own]).astype(np.int32)), pa.array(hashes_of(sums, start, start + length).view(np.int64)), pa.array(hashes_of(turned, start, start + length).view(np.int64))],
                    ["h", "c", "times", "at", "w1", "w2"],
                )

    return tidy(run)


def _joined(length: int):
    """Spans of the starts that a run's list names."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            spans = [np.array([(x, x + length) for x in sorted(at)], "<i4").tobytes() for at in batch.column(batch.schema.names.index("starts")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.names.index(x)) for x in ("h", "c")], pa.array(spans, pa.binary())], ["h", "c", "spans"])

    return run


def repeated_spans(work: DataFrame, length: int) -> tuple[DataFrame, list[str]]:
    """(_row, found: array of (pos, spans)) of work(_row, text): the parts that are covered by repeated strings; and the folders to discard."""
    spark = work.sparkSession
    marks, at_marks = stored(work.select("_row", "text").mapInArrow(_marks(length), "h long, c long, _row long, pos long, n int, seeds int"), "marks")
    shared = marks.groupBy("h").agg(F.sum("seeds").alias("_s")).where("_s >= 2").select("h")
    runs, at_runs = stored(marks.join(shared.hint("merge"), "h").groupBy("h", "c").agg(F.count("*").alias("times"), F.min(F.struct("_row", "pos")).alias("at"), F.first("n").alias("n"), F.max("seeds").alias("seeds")), "runs")
    # a group all of whose runs have copies needs no text, nor does one of a single run with a single seed
    groups, at_groups = stored(
        runs.groupBy("h").agg(F.count_if(F.col("times") == 1).alias("open"), F.sum(F.col("n") + length - 1).alias("size"), F.sum("seeds").alias("_s")).where("open > 0 AND _s > 1").select("h", "size"), "groups"
    )
    size = groups.agg(F.sum("size")).collect()[0][0] or 0
    wanted = (
        runs.join(groups.hint("merge"), "h").select(F.col("at._row").alias("_at"), F.struct("at.pos", "n", "h", "c", "times", (F.col("size") > HOT).alias("hot")).alias("w"))
        .groupBy("_at").agg(F.collect_list("w").alias("wanted"))
    )
    contexts, at_contexts = stored(
        work.join(wanted.hint("merge"), work["_row"] == wanted["_at"]).select("text", "wanted").mapInArrow(_contexts(length), "h long, c long, n int, times long, hot boolean, bytes binary"), "contexts"
    )
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (8 << 20)))
    few = contexts.where("NOT hot").repartition(parts, "h").sortWithinPartitions("h").mapInArrow(_spans(length), "h long, c long, spans binary")
    # the strings of a large group are told apart by hashes of all their bytes, counted before they are sent
    strings = contexts.where("hot").mapInArrow(_windows(length), "h long, c long, times long, at int, w1 long, w2 long")
    twice = strings.groupBy("h", "w1", "w2").agg(F.sum("times").alias("_n")).where("_n >= 2").drop("_n")
    many = strings.where("times = 1").join(twice.hint("merge"), ["h", "w1", "w2"]).groupBy("h", "c").agg(F.collect_list("at").alias("starts")).mapInArrow(_joined(length), "h long, c long, spans binary")
    copies = runs.where("times > 1").select("h", "c", F.lit(None).cast("binary").alias("spans"))
    covered, at_covered = stored(few.unionByName(many).unionByName(copies), "covered")
    found = marks.join(covered.hint("merge"), ["h", "c"]).groupBy("_row").agg(F.collect_list(F.struct("pos", "n", "spans")).alias("found"))
    return found, [at_marks, at_runs, at_groups, at_contexts, at_covered]


def _cut(length: int):
    """What is left of each text, and how much was removed in how many pieces."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            names = batch.schema.names
            kept, sizes, removed, pieces = [], [], [], []
            for text, found in zip(batch.column(names.index("text")), batch.column(names.index("found"))):
                raw = text.as_buffer().to_pybytes()
                change = np.zeros(len(raw) + 1, np.int32)
                for f in found.as_py() or ():
                    spans = np.array([[0, f["n"] + length - 1]]) if f["spans"] is None else np.frombuffer(f["spans"], "<i4").reshape(-1, 2)
                    np.add.at(change, spans[:, 0] + f["pos"], 1)
                    np.add.at(change, spans[:, 1] + f["pos"], -1)
                gone = np.cumsum(change[:-1]) > 0
                kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes() if found.is_valid else raw)
                sizes.append(len(raw))
                removed.append(int(gone.sum()))
                pieces.append(int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1)))
            rest = [(batch.column(i), x) for i, x in enumerate(names) if x not in ("text", "found", "_row")]
            yield pa.RecordBatch.from_arrays([*[c for c, _ in rest], pa.array(kept, pa.binary()), *[pa.array(x, pa.int64()) for x in (sizes, removed, pieces)]], names=[*[x for _, x in rest], "_kept", "_n_bytes", "_n_removed", "_n_spans"])

    return tidy(run)


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = 400) -> DataFrame:
    """docs with kept (binary), n_bytes, n_removed and n_spans added.

    A text is its UTF-8 bytes. Each byte goes that is covered by a string of `length`
    bytes (at least 16) that starts anywhere else too, in the same text or another;
    overlapping starts count, and all are judged on the input. No string crosses texts.

    Strings are grouped by their least seed hash, as runs of neighbouring starts. Runs
    with equal bytes are one. Suffix arrays over whole groups of runs, with their common
    prefixes, are scanned for maximal repeats, each with all its starts; these cover
    what goes. The strings of a group beyond HOT bytes are told by two hashes instead.

    Null and empty texts have nothing to remove and are empty; repeated rows are texts
    of their own, so a repeated text of `length` bytes or more goes whole, whatever its
    id, which may be null. An empty table gives an empty result. Other columns pass
    through; kept, n_bytes, n_removed and n_spans are replaced if present, names that
    begin with _ are reserved.
    """
    if length < 16:
        raise ValueError("length must be at least 16")
    spark = docs.sparkSession
    small_batches(spark)
    names = [c for c in docs.columns if c not in ("kept", "n_bytes", "n_removed", "n_spans")]
    own = docs.select(F.monotonically_increasing_id().alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(*names).alias("_own"))
    own = own.withColumn("_own", F.struct(*[F.col(f"_own.`{c}`").alias(c) for c in names if c != text_col], F.col(f"_own.`{text_col}`").isNull().alias("_null")))
    work = materialize(own, "texts")  # so that a row keeps its number
    found, folders = repeated_spans(work, length)
    found, at_found = stored(found.withColumnRenamed("_row", "_at"), "spans")
    for path in folders:
        discard(spark, path)
    joined = work.join(found.hint("merge"), work["_row"] == found["_at"], "left").select("_own", "text", F.col("text").alias("_text"), "found")
    schema = T.StructType([work.schema["_own"], T.StructField("_text", T.StringType()), T.StructField("_kept", T.BinaryType()), *[T.StructField(x, T.LongType()) for x in ("_n_bytes", "_n_removed", "_n_spans")]])
    done = joined.mapInArrow(_cut(length), schema)
    back = [F.when(~F.col("_own._null"), F.col("_text")).alias(c) if c == text_col else F.col(f"_own.`{c}`").alias(c) for c in names]
    return done.select(*back, F.col("_kept").alias("kept"), F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"), F.col("_n_spans").alias("n_spans"))


def op11_repeats(docs: DataFrame) -> DataFrame:
    done = remove_repeats(docs.select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
