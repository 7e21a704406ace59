"""Audio columns: chroma fingerprints, and the alignment of recordings by them."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, tidy

RATE, FRAME, HOP = 4000, 1024, 256
CLASSES, LOW_HZ, HIGH_HZ = 12, 60.0, 1900.0
SMOOTHING = (0.25, 0.75, 1.0, 0.75, 0.25)
#: Each filter compares two areas of the image of frames x pitch classes: kind, first class, classes, frames. Two bits a filter make 32.
FILTERS = [(k % 6, (5 * k) % 9, 3 + k % 2, 4 + 4 * (k % 4)) for k in range(16)]
WIDEST = max(f[3] for f in FILTERS)
#: A filter's value is cut into four steps here.
STEPS = (-0.25, 0.0, 0.25)
#: Aligned recordings overlap in so many integers at an offset, and differ there in so small a share of bits.
MIN_OVERLAP, MAX_ERROR = 16, 0.2
#: Bits of each integer that noise is likeliest to flip, and votes for an offset from which it is tried.
DOUBTS, MIN_VOTES = 6, 2
#: Recordings in a block of queries and in a shard of the others, and integers in each, at most (one recording may have more); votes that a task counts at once.
BLOCK, SHARD, VOTES = 128, 2048, 4_000_000
BLOCK_ITEMS, SHARD_ITEMS = 32_000, 400_000
#: Blocks and shards that meet under a key, about; fewer shards where that would make fewer keys than KEYS.
BLOCKS_MET, SHARDS_MET, KEYS = 64, 8, 32
#: Samples whose frames a task holds at once, about: of several recordings, or a section of a long one.
SAMPLES = 1 << 20


def pcm16(value):
    """Samples of 16-bit little-endian mono PCM."""
    import numpy as np

    return np.frombuffer(value[: len(value) // 2 * 2], "<i2").astype(float) / 32768


@functools.lru_cache(maxsize=4)
def _tones(notes: int):
    """Each pitch of a melody for so many notes' time."""
    import numpy as np

    t = np.arange(notes * (FRAME // 2)) / RATE
    return np.stack([np.sin(2 * np.pi * 440 * 2 ** ((pitch - 69) / 12) * t) for pitch in range(48, 84)]).reshape(36, notes, FRAME // 2)


def melody(vector):
    """A recording of a vector: a note for each component, of 0.128 s at RATE; null and non-finite components are rests."""
    import numpy as np

    x = np.array([np.nan if v is None else v for v in vector], float)
    rest = ~np.isfinite(x)
    pitch, out = (np.floor(np.where(rest, 0, x) * 64) % 36).astype(int), []
    # long ones in parts that fit the table; tones begin anew every 16 s
    for lo in range(0, len(x), 125):
        part = slice(lo, lo + 125)
        tones = _tones(len(x[part]))
        out.append(np.where(rest[part, None], 0.0, tones[pitch[part], np.arange(tones.shape[1])]).ravel())
    return np.concatenate(out) if out else np.zeros(0)


def chroma(samples):
    """recordings x frames x CLASSES of recordings of one length: energy by pitch class, smoothed over frames, of length 1 (silence stays 0)."""
    import numpy as np

    if samples.shape[1] < FRAME:
        return np.zeros((len(samples), 0, CLASSES))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME, axis=1)[:, ::HOP]
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    use = (hz >= LOW_HZ) & (hz <= HIGH_HZ)
    spectrum = np.fft.rfft(frames * np.hamming(FRAME), axis=2)[:, :, use]
    power = spectrum.real**2 + spectrum.imag**2
    note = np.round(12 * np.log2(hz[use] / 440)).astype(int) % CLASSES
    image = power @ (note[:, None] == np.arange(CLASSES)).astype(float)
    k, n = len(SMOOTHING), image.shape[1]
    if n < k:
        return np.zeros((len(samples), 0, CLASSES))
    image = sum(w * image[:, i : n - k + 1 + i] for i, w in enumerate(SMOOTHING))
    size = np.sqrt((image**2).sum(axis=2, keepdims=True))
    return np.where(size > 1e-6, image / np.maximum(size, 1e-6), 0.0)


def filtered(image):
    """recordings x filters x places: the two areas that each filter compares. Sums over areas are differences in the integral image."""
    import numpy as np

    n = image.shape[1] - WIDEST + 1
    total = np.zeros((len(image), image.shape[1] + 1, CLASSES + 1))
    total[:, 1:, 1:] = image.cumsum(axis=1).cumsum(axis=2)

    def area(t0, t1, c0, c1):
        return total[:, t1 : t1 + n, c1] - total[:, t0 : t0 + n, c1] - total[:, t1 : t1 + n, c0] + total[:, t0 : t0 + n, c0]

    pairs = []
    for kind, c, h, w in FILTERS:
        whole, half, third, mid = area(0, w, c, c + h), w // 2, w // 3, c + h // 2
        if kind == 0:
            a, b = whole, area(0, w, 0, CLASSES) - whole
        elif kind == 1:
            a = area(0, w, mid, c + h)
        elif kind == 2:
            a = area(half, w, c, c + h)
        elif kind == 3:
            a = area(half, w, c, mid) + area(0, half, mid, c + h)
        elif kind == 4:
            a = area(0, w, c + h // 3, c + h - h // 3)
        else:
            a = area(third, w - third, c, c + h)
        pairs.append((a, b if kind == 0 else whole - a))
    return np.stack([a for a, _ in pairs], axis=1), np.stack([b for _, b in pairs], axis=1)


def fingerprints(samples):
    """(items, doubts) of recordings of one length: a 32-bit integer for each place of the widest filter, and one whose bits are the DOUBTS likeliest to flip. Long ones go by sections of places, whose frames overlap."""
    import numpy as np

    places, beside = max(1, SAMPLES // HOP), WIDEST + len(SMOOTHING) - 2
    frames = max(0, (samples.shape[1] - FRAME) // HOP + 1)
    own = [samples[:, lo * HOP : (min(lo + places, frames - beside) + beside - 1) * HOP + FRAME] for lo in range(0, max(1, frames - beside), places)]
    return tuple(np.concatenate(x, axis=1) for x in zip(*map(_section, own)))


def _section(samples):
    import numpy as np

    image = chroma(samples)
    if image.shape[1] < WIDEST:
        return np.zeros((len(image), 0), "uint32"), np.zeros((len(image), 0), "uint32")
    a, b = filtered(image)
    value = np.log((1 + a) / (1 + b))
    step = np.searchsorted(STEPS, value, side="right")
    shift = (2 * np.arange(len(FILTERS) - 1, -1, -1)).astype("uint32")[None, :, None]
    code = np.array([0, 1, 3, 2], "uint32")[step]  # neighbours differ in a bit
    items = np.bitwise_or.reduce(code << shift, axis=1)
    far = np.abs(value[:, None] - np.array(STEPS)[None, :, None, None])
    # crossing the middle step flips a code's high bit, an outer one its low bit
    bit = np.uint32(1) << (shift + (far.argmin(axis=1) == 1).astype("uint32"))
    least = np.argpartition(far.min(axis=1), DOUBTS, axis=1)[:, :DOUBTS]
    return items, np.bitwise_or.reduce(np.take_along_axis(bit, least, axis=1), axis=1)


def fingerprint(samples):
    return fingerprints(samples[None])[0][0]


def _fingerprints(decode):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            names = batch.schema.names
            keep, media = [i for i, c in enumerate(names) if c != "_media"], batch.column(names.index("_media"))
            out = [[None] * batch.num_rows, [None] * batch.num_rows]
            waiting: dict = {}

            def done(n, out=out, waiting=waiting):
                rows, sounds = zip(*waiting.pop(n))
                for to, found in zip(out, fingerprints(np.stack(sounds))):
                    for i, x in zip(rows, found):
                        to[i] = x.astype("<u4").tobytes()

            held = 0
            for i, value in enumerate(media):
                if not value.is_valid:
                    continue
                sound = decode(value.as_py())
                n = len(sound)
                waiting.setdefault(n, []).append((i, sound))
                held += n
                # recordings of one length together, but no more than a section's samples
                if len(waiting[n]) >= max(1, min(32, SAMPLES // max(n, 1))):
                    held -= n * len(waiting[n])
                    done(n)
                if held > 4 * SAMPLES:
                    for m in list(waiting):
                        done(m)
                    held = 0
            for m in list(waiting):
                done(m)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], *[pa.array(x, pa.binary()) for x in out]], names=[*[names[i] for i in keep], "fingerprint", "doubts"])

    return tidy(run)


def with_fingerprints(media: DataFrame, media_col: str, decode=pcm16) -> DataFrame:
    """media's columns but media_col, and fingerprint and doubts (little-endian 32-bit integers; a doubt's bits are those of its item that noise is likeliest to flip).

    decode makes samples at RATE of a value. Null media have a null fingerprint; silence
    and recordings too short for the widest filter an empty one, or one of zeros' bits.
    """
    given = media.select(*[c for c in media.columns if c not in (media_col, "fingerprint", "doubts")], F.col(media_col).alias("_media"))
    return given.mapInArrow(_fingerprints(decode), given.drop("_media").schema.add("fingerprint", "binary").add("doubts", "binary"))


def _packed(size, most):
    def run(batches):
        """Recordings as rows of `size`, and of `most` integers, at most: their ids, the ends of their fingerprints, and these with their doubts one after the other."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            upto, lo = np.cumsum(pc.binary_length(batch.column(1)).to_numpy().astype("int64") // 4), 0
            while lo < batch.num_rows:
                hi = min(lo + size, max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, side="right"))))
                part = batch.slice(lo, hi - lo)
                lo = hi
                ids = part.column(0).to_numpy().astype("<i8")
                prints, doubts = part.column(1).to_pylist(), part.column(2).to_pylist()
                ends = np.cumsum([len(x) // 4 for x in prints]).astype("<i8")
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (ids.tobytes(), ends.tobytes(), b"".join(prints), b"".join(doubts))], names=["ids", "ends", "items", "doubts"])

    return tidy(run)


class Probes:
    """A block of queries: each item as it is and with all subsets of its doubtful bits flipped, in order, to be found by other recordings' items."""

    def __init__(self, ids, ends, items, doubts):
        import numpy as np

        self.np, self.ids = np, ids
        self.prints = np.split(items, ends[:-1])
        sizes = np.diff(np.append(0, ends))
        query = np.repeat(np.arange(len(ids)), sizes)
        place = np.arange(len(items)) - np.repeat(ends - sizes, sizes)
        self.query_of, self.place_of, self.items, self.doubts = query, place, items, doubts
        self.parts = [slice(i, i + BLOCK_ITEMS) for i in range(0, max(1, len(items)), BLOCK_ITEMS)]
        self._look_up(self.parts[0])

    def _look_up(self, part):
        """From now on the probes are those of a part of the items; a block has one, but for a long recording."""
        np, items, left = self.np, self.items[part], self.doubts[part].copy()
        keys = items[None]
        while left.any():
            bit = left & (~left + np.uint32(1))
            keys = np.concatenate([keys, keys ^ bit])
            left ^= bit
        own = np.tile(np.arange(len(items)), len(keys))
        keys = keys.ravel()
        both = np.unique(keys.astype("uint64") << np.uint64(32) | own.astype("uint64"))
        self.keys, own = (both >> np.uint64(32)).astype("uint32"), (both & np.uint64(0xFFFFFFFF)).astype("int64")
        self.query, self.place = self.query_of[part][own], self.place_of[part][own]
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self._slot(self.keys)] = True

    def _slot(self, items):
        return (items * self.np.uint32(0x9E3779B1)) >> self.np.uint32(10)

    def votes(self, items, recording, place, n_recordings, span):
        """(query, recording, offset, votes) of each that has MIN_VOTES; span exceeds all places."""
        np = self.np
        key, count = np.zeros(0, "int64"), np.zeros(0, "int64")
        for part in self.parts:
            if len(self.parts) > 1:
                self._look_up(part)
            there = np.nonzero(self.seen[self._slot(items)])[0]
            lo = np.searchsorted(self.keys, items[there], "left")
            n = np.searchsorted(self.keys, items[there], "right") - lo
            there, lo, n = there[n > 0], lo[n > 0], n[n > 0]
            upto, i = np.cumsum(n), 0
            while i < len(there):
                # as many items as make VOTES votes, one at least
                j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + VOTES, side="right")))
                k = n[i:j]
                at = np.repeat(lo[i:j] - np.cumsum(k) + k, k) + np.arange(k.sum())
                item = np.repeat(there[i:j], k)
                new = (self.query[at] * n_recordings + recording[item]) * (2 * span) + self.place[at] - place[item] + span
                new, m = np.unique(new, return_counts=True)
                key, back = np.unique(np.concatenate([key, new]), return_inverse=True)
                count = np.bincount(back, np.concatenate([count, m]), len(key)).astype("int64")
                i = j
        key, count = key[count >= MIN_VOTES], count[count >= MIN_VOTES]
        pair, offset = np.divmod(key, 2 * span)
        query, other = np.divmod(pair, n_recordings)
        return zip(query.tolist(), other.tolist(), (offset - span).tolist(), count.tolist())

    def every(self, prints):
        """All offsets of all pairs, without votes."""
        for q, a in enumerate(self.prints):
            for c, b in enumerate(prints):
                yield from ((q, c, offset, 0) for offset in range(MIN_OVERLAP - len(b), len(a) - MIN_OVERLAP + 1))


def errors(a, b, offset: int) -> tuple[float, int]:
    """(share of bits that differ, overlap) of two fingerprints at an offset."""
    import numpy as np

    a, b = (a[offset:], b) if offset >= 0 else (a, b[-offset:])
    n = min(len(a), len(b))
    return (int(np.bitwise_count(a[:n] ^ b[:n]).sum()) / (32 * n), n) if n else (1.0, 0)


def _aligned(exact):
    def run(batches):
        """Rows by key, its shards (block false) before its blocks: the shards are held, and each block meets all of them."""
        import numpy as np
        import pyarrow as pa

        names, kinds = ["query_id", "class_id", "offset", "votes", "bit_error", "overlap"], (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.int64())
        last, shards = None, []
        for batch in batches:
            col = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            for row in range(batch.num_rows):
                read = lambda c, kind, r=row: np.frombuffer(col[c][r].as_py(), kind)
                ids, ends, items = read("ids", "<i8"), read("ends", "<i8"), read("items", "<u4")
                if last != (key := col["key"][row].as_py()):
                    last, shards = key, []
                if not col["block"][row].as_py():
                    sizes = np.diff(np.append(0, ends))
                    recording, place = np.repeat(np.arange(len(ids)), sizes), np.arange(len(items)) - np.repeat(ends - sizes, sizes)
                    # of a run of one value, as silence makes, the first place is looked up; queries hold all of theirs
                    first = np.append(True, items[1:] != items[:-1]) | (place == 0)
                    shards.append((ids, np.split(items, ends[:-1]), items[first], recording[first], place[first]))
                    continue
                probes = Probes(ids, ends, items, read("doubts", "<u4")) if shards else None
                for others, prints, found, recording, place in shards:
                    span = max(max(map(len, prints), default=0), max(map(len, probes.prints), default=0)) + 1
                    tried = probes.every(prints) if exact else probes.votes(found, recording, place, len(others), span)
                    best: dict = {}
                    for q, c, offset, votes in tried:
                        if ids[q] != others[c]:
                            error, n = errors(probes.prints[q], prints[c], offset)
                            if n >= MIN_OVERLAP and error <= MAX_ERROR:
                                best[q, c] = min(best.get((q, c), (2.0,)), (error, -n, offset, votes))
                    rows = [(int(ids[q]), int(others[c]), offset, votes, error, -n) for (q, c), (error, n, offset, votes) in best.items()]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    return tidy(run)


def classes_of(prints: DataFrame, id_col: str) -> DataFrame:
    """(fp_hash, class_id, fingerprint, doubts) of each distinct, non-empty fingerprint; class_id is the smallest id that has it."""
    has = prints.where(F.col(id_col).isNotNull() & (F.octet_length("fingerprint") > 0))
    found = has.groupBy(F.unhex(F.md5("fingerprint")).alias("fp_hash")).agg(F.min(F.struct(F.col(id_col).alias("class_id"), "fingerprint", "doubts")).alias("x"))
    return found.select("fp_hash", "x.*")


def align(queries: DataFrame, classes: DataFrame, exact: bool = False) -> DataFrame:
    """query_id, class_id, offset, votes, bit_error, overlap: recordings of classes(class_id, fingerprint, doubts) that align with one of queries (the same columns).

    Two recordings align at an offset if they overlap there in MIN_OVERLAP integers at
    least, of whose bits at most MAX_ERROR differ; of several offsets the one of the
    fewest errors is returned (ties: the longest overlap, then the smallest offset).
    Offsets are tried that MIN_VOTES integers of the recording vote for, each by being
    equal to one of the query's as it is or with some of its doubtful bits flipped; with
    exact, all offsets of all pairs are.

    Blocks of queries meet shards of the others under keys: SHARDS_MET shards and
    BLOCKS_MET blocks a key, each sent once for each group of the others that it meets.
    They are put one below the other, not joined, so nothing is sent to the driver or to
    all tasks; votes are counted where they meet, and only alignments come out.
    Blocks and shards are bounded by integers as well as recordings, and a long query's
    probes are made a part at a time, so minutes or hours of sound take no more memory.

    Repeated rows of queries or classes count each; empty tables give no rows; a null
    class_id aligns with nothing.
    """
    packed = "ids binary, ends binary, items binary, doubts binary"
    pick = lambda df: df.where("class_id IS NOT NULL").select("class_id", "fingerprint", "doubts")
    blocks, shards = (materialize(pick(df).mapInArrow(_packed(size, most), packed), name) for df, size, most, name in ((queries, BLOCK, BLOCK_ITEMS, "query-blocks"), (classes, SHARD, SHARD_ITEMS, "shards")))
    n_shards = shards.count()
    rows, cols = max(1, -(-n_shards // max(1, min(SHARDS_MET, n_shards // KEYS)))), max(1, -(-blocks.count() // BLOCKS_MET))
    group, each = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int"), lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    shards = shards.withColumns({"row": group(rows), "col": each(cols), "block": F.lit(False), "doubts": F.lit(None).cast("binary")})
    blocks = blocks.withColumns({"row": each(rows), "col": group(cols), "block": F.lit(True)})
    tiles = shards.unionByName(blocks).withColumn("key", F.col("row") * cols + F.col("col")).drop("row", "col")
    # not put together: a key takes long for its bytes
    tiles = tiles.repartition(2 * rows * cols, "key").sortWithinPartitions("key", "block")
    return tiles.mapInArrow(_aligned(exact), "query_id long, class_id long, offset int, votes long, bit_error double, overlap long")


def op3_audio(vectors: DataFrame) -> DataFrame:
    """vec_id, n_items, class_id, is_query, n_matches, best_query, best_offset, best_votes, best_error for each vector's recording.

    Recordings with equal fingerprints are one class, named by the smallest vec_id;
    queries are the classes of vectors whose vec_id is divisible by 50. n_matches counts
    the queries, other than its own class, that align with the class; the best has the
    fewest bit errors, then the smallest id (ties in offset: as align has it). Null vectors
    have no fingerprint and no class; too short ones an empty fingerprint, no class and no
    matches. Repeated rows each have theirs; a row of a null vec_id has the class of its
    fingerprint, if another row names it, and asks nothing. An empty table gives an empty
    result.
    """
    prints = materialize(with_fingerprints(vectors.select("vec_id", "embedding"), "embedding", melody).withColumn("fp_hash", F.when(F.octet_length("fingerprint") > 0, F.unhex(F.md5("fingerprint")))), "fingerprints")
    classes = materialize(classes_of(prints, "vec_id"), "classes")
    asked = prints.where("vec_id % 50 = 0").select("fp_hash").distinct()
    # sorted at every size: what is broadcast goes through the driver
    queries = materialize(classes.join(asked.hint("merge"), "fp_hash", "left_semi").select("class_id", "fingerprint", "doubts"), "queries")
    found = materialize(align(queries, classes), "aligned")
    best = found.groupBy("class_id").agg(F.count("*").alias("n_matches"), F.min(F.struct("bit_error", "query_id", "offset", "votes")).alias("b"))
    known = classes.select("fp_hash", "class_id").join(best.hint("merge"), "class_id", "left").join(queries.select("class_id", F.lit(True).alias("is_query")).hint("merge"), "class_id", "left")
    known = materialize(known.select("fp_hash", "class_id", F.coalesce("is_query", F.lit(False)).alias("is_query"), F.coalesce("n_matches", F.lit(0)).alias("n_matches"), F.col("b.query_id").alias("best_query"), F.col("b.offset").alias("best_offset"), F.col("b.votes").alias("best_votes"), F.col("b.bit_error").alias("best_error")), "known")
    return prints.select("vec_id", (F.octet_length("fingerprint") / 4).cast("long").alias("n_items"), "fp_hash").join(known.hint("merge"), "fp_hash", "left").drop("fp_hash")
