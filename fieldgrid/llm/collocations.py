"""Phrase collocations by mergeable summaries and an exact second pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, byte_slices, materialize, small_batches, tidy
from .rolling import hashes_of, prefix_sums

#: Bytes that end a piece, and those that separate words within it.
STOPS, GAPS = ".,;:!?\n\x0b\x0c\r", " \t"
#: A summary's share of the phrases' occurrences, about; occurrences that a task counts before it sends them on.
PART_MASS, FLUSH = 1_000_000, 2_000_000
#: The filter between the passes has at most this many bits (as a power of two), so what is broadcast is 16 MB at most.
#: Where more phrases are frequent than it can tell apart, more of the others pass it, to be counted in vain.
FILTER_BITS = 27
#: Rows of one language that one window ranks, about.
RANK_ROWS = 100_000


def phrase_slices(batch, text: str = "text", most: int = 1 << 20):
    """(bytes, start, end, piece, row) of the words of slices of a batch: bytes are the words in lower case with a space between.

    A text longer than a slice is cut behind a byte that ends a piece, so no phrase is cut.
    """
    import numpy as np

    kind = np.zeros(256, np.uint8)
    kind[[ord(c) for c in GAPS]], kind[[ord(c) for c in STOPS]] = 1, 2
    lower = np.arange(256, dtype=np.uint8)
    lower[[ord(c) for c in UPPER]] = [ord(c) for c in LOWER]
    at = 0
    for part in byte_slices(batch, text, most):
        column = part.column(part.schema.names.index(text))
        offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
        held = column.buffers()[2]
        data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
        first = offsets - offsets[0]
        lo = 0
        while lo < len(data):
            hi = len(data)
            if hi - lo > 2 * most:
                stops = np.flatnonzero(kind[data[lo : lo + most]] == 2)
                if not len(stops):
                    stops = np.flatnonzero(kind[data[lo:]] == 2)[:1]
                hi = lo + int(stops[-1]) + 1 if len(stops) else hi
            own, k = data[lo:hi], kind[data[lo:hi]]
            begins = np.zeros(len(own) + 1, bool)
            begins[first[(first >= lo) & (first <= hi)] - lo] = True
            letter = k == 0
            start = letter.copy()
            start[1:] &= ~letter[:-1] | begins[1:-1]
            word = np.flatnonzero(start)
            if len(word):
                used = np.flatnonzero(letter)
                number = np.cumsum(start)[used] - 1
                out = np.full(len(used) + len(word) - 1, 32, np.uint8)
                out[np.arange(len(used)) + number] = lower[own[used]]
                length = np.bincount(number)
                end = np.cumsum(length + 1) - 1
                piece = np.cumsum((k == 2) | begins[:-1])[word]
                yield out, end - length, end, piece, at + np.searchsorted(first, word + lo, side="right") - 1
            lo = hi
        at += part.num_rows


def _phrases(spans, salts, least: int, longest: int):
    """(hash, index of the first word, number of words) of all phrases of a slice."""
    import numpy as np

    data, start, end, piece, row = spans
    sums = prefix_sums(data)
    hashed, index, size = [], [], []
    for n in range(least, longest + 1):
        if n > len(start):
            break
        i = np.flatnonzero(piece[: len(start) - n + 1] == piece[n - 1 :])
        hashed.append(hashes_of(sums, start[i], end[i + n - 1], salts[row[i]]))
        index.append(i)
        size.append(np.full(len(i), n, np.int8))
    return np.concatenate(hashed), np.concatenate(index), np.concatenate(size)


def _salts(batch):
    import hashlib

    import numpy as np

    column = batch.column(batch.schema.names.index("lang"))
    known = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in column.unique().to_pylist()}
    return np.array([known[x] for x in column.to_pylist()], np.uint64)


def _combined(keys, counts):
    """Sorted distinct keys and the sums of their counts."""
    import numpy as np

    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def _send(part_bits: int, longest: int):
    """Counts of phrases' hashes by hash partition: a row a partition and flush."""

    def rows(keys, counts):
        import numpy as np
        import pyarrow as pa

        part = (keys >> np.uint64(64 - part_bits)).astype(np.int64)
        low = (keys << np.uint64(part_bits) >> np.uint64(32)).astype("<u4")
        out = []
        for wide in (False, True):
            own = np.flatnonzero((counts > 255) == wide)
            parts, first = np.unique(part[own], return_index=True)
            for p, i in zip(parts, np.split(own, first[1:]) if len(parts) else []):
                out.append((int(p), low[i].tobytes(), counts[i].astype("<u8" if wide else "u1").tobytes(), wide))
        cols = list(zip(*out)) if out else [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.binary(), pa.binary(), pa.bool_()))], ["part", "keys", "counts", "wide"])

    def run(batches):
        import numpy as np

        done, fresh, n = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), [], 0
        for batch in batches:
            salts = _salts(batch)
            for spans in phrase_slices(batch):
                fresh.append(_phrases(spans, salts, 1, longest)[0])
                n += len(fresh[-1])
                if n >= FLUSH // 4:
                    keys, counts = _combined(h := np.concatenate(fresh), np.ones(len(h), np.int64))
                    done, fresh, n = _combined(np.concatenate([done[0], keys]), np.concatenate([done[1], counts])), [], 0
                    if len(done[0]) >= FLUSH:
                        yield rows(*done)
                        done = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        fresh = np.concatenate([np.zeros(0, np.uint64), *fresh])
        done = _combined(np.concatenate([done[0], fresh]), np.concatenate([done[1], np.ones(len(fresh), np.int64)]))
        if len(done[0]):
            yield rows(*done)

    return tidy(run)


def merged(a, b, capacity: int):
    """The sum of two Misra-Gries summaries (keys, counts, most that was taken from any count), cut to its capacity.

    What is cut is taken from all counts alike, so a count falls short by at most the
    mass divided by capacity + 1, in whatever order summaries are merged.
    """
    import numpy as np

    keys, counts = _combined(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]))
    taken = a[2] + b[2]
    if len(keys) > capacity:
        cut = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
        counts = counts - cut
        keys, counts, taken = keys[counts > 0], counts[counts > 0], taken + cut
    return keys, counts, taken


def _survivors(threshold: int, address_bits: int):
    """The part of the filter that a hash partition has: a bit for each address at which a count may reach the threshold."""

    def run(key, pdf):
        import numpy as np
        import pandas as pd

        read = [(np.frombuffer(r.keys, "<u4"), np.frombuffer(r.counts, "<u8" if r.wide else "u1").astype(np.int64)) for r in pdf.itertuples(index=False)]
        capacity = sum(int(c.sum()) for _, c in read) // threshold + 1
        summary, waiting, n = (np.zeros(0, np.uint32), np.zeros(0, np.int64), 0), [], 0
        for i, part in enumerate(read):
            waiting.append(part)
            n += len(part[0])
            if n >= max(len(summary[0]), 1 << 17) or i == len(read) - 1:
                summary = merged(summary, (*_combined(np.concatenate([k for k, _ in waiting]), np.concatenate([c for _, c in waiting])), 0), capacity)
                waiting, n = [], 0
        bits = np.zeros(1 << address_bits, bool)
        bits[summary[0][summary[1] + summary[2] >= threshold] >> np.uint32(32 - address_bits)] = True
        return pd.DataFrame([{"part": key[0], "bits": np.packbits(bits, bitorder="little").tobytes()}])

    return run


def _count(filter_bits: int, part_bits: int, held, longest: int):
    """Phrases that pass the filter and their occurrences in the task, as a table (lang, phrase, f) for each hash partition; and all words of a language as the empty phrase."""

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        bits = np.frombuffer(held.value, np.uint8)
        names: list = []
        words: dict = {}
        sums: dict = {}

        def fresh():
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), [], np.zeros(0, np.int64)

        def batch_of(keys, counts, texts, langs):
            # in order of key; texts come in the order of the numbers that the keys carry
            order = pa.array(number) if len(number) else pa.array(np.arange(len(keys)))
            whole = pa.table([pa.array(names, pa.string()).take(pa.array(langs)), pa.concat_arrays([*texts, pa.array([], pa.string())]), pa.array(counts, pa.int64())], ["lang", "phrase", "f"]).take(order)
            parts, first = np.unique(keys >> np.uint64(64 - part_bits), return_index=True)
            out = [packed(whole.slice(a, b - a)) for a, b in zip(first, [*first[1:], len(keys)])]
            return pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), pa.array(out, pa.binary())], ["part", "phrases"])

        # keys stay sorted; number[i] is where the text of keys[i] is among the texts
        keys, number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        counts, langs, texts = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        for batch in batches:
            salts, lang = _salts(batch), batch.column(batch.schema.names.index("lang")).to_pylist()
            for x in dict.fromkeys(lang):
                if x not in words:
                    words[x] = len(names)
                    names.append(x)
            code = np.array([words[x] for x in lang], np.int64)
            total = np.zeros(len(names), np.int64)
            for spans in phrase_slices(batch):
                data, start, end, _, row = spans
                np.add.at(total, code[row], 1)
                h, i, n = _phrases(spans, salts, 1, longest)
                address = h >> np.uint64(64 - filter_bits)
                passed = np.flatnonzero(bits[(address >> np.uint64(3)).astype(np.int64)] >> (address & np.uint64(7)).astype(np.uint8) & 1)
                found, first, times = np.unique(h[passed], return_index=True, return_counts=True)
                at = np.searchsorted(keys, found)
                old = np.zeros(len(found), bool)
                inside = at < len(keys)
                old[inside] = keys[at[inside]] == found[inside]
                counts[number[at[old]]] += times[old]
                new = ~old
                if new.any():
                    pick = passed[first[new]]
                    a, b = start[i[pick]], end[i[pick] + n[pick] - 1]
                    size = b - a
                    ends = np.cumsum(size)
                    gather = np.arange(ends[-1]) + np.repeat(a - (ends - size), size)
                    texts.append(pa.StringArray.from_buffers(len(size), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(data[gather])))
                    number = np.insert(number, at[new], len(counts) + np.arange(len(pick)))
                    keys = np.insert(keys, at[new], found[new])
                    counts, langs = np.concatenate([counts, times[new]]), np.concatenate([langs, code[row[i[pick]]]])
                if len(keys) >= FLUSH // 4:
                    yield batch_of(keys, counts, texts, langs)
                    keys, counts, texts, langs = fresh()
                    number = np.zeros(0, np.int64)
            some = np.flatnonzero(total)
            for x in some.tolist():
                sums[x] = sums.get(x, 0) + int(total[x])
        if len(keys):
            yield batch_of(keys, counts, texts, langs)
        number = np.zeros(0, np.int64)
        for x, n in sums.items():  # a language's words meet in one partition
            yield batch_of(np.array([zlib.crc32(names[x].encode()) << 32], np.uint64), [n], [pa.array([""])], [x])

    return tidy(run)


def packed(table) -> bytes:
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def _sum(threshold: int):
    """The counts of a hash partition's phrases, by their text, that reach the threshold."""

    def run(key, rows):
        import pyarrow as pa
        import pyarrow.compute as pc

        parts = pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in rows.column("phrases")])
        total = parts.group_by(["lang", "phrase"]).aggregate([("f", "sum")])
        total = total.filter(pc.or_(pc.greater_equal(total["f_sum"], threshold), pc.equal(total["phrase"], "")))
        return pa.table([total["lang"], total["phrase"], total["f_sum"]], ["lang", "phrase", "f"])

    return run


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 3, threshold: int = 10, filter_bits: int | None = None, part_mass: int | None = None) -> DataFrame:
    """lang, phrase (its words with a space between), f: all phrases of up to `longest` words with f >= threshold; the empty phrase has the language's words, whatever their number.

    Two passes. The first sends counts of hashes to hash partitions, whose number grows
    with the texts; each folds them into a Misra-Gries summary with more places than its
    mass divided by the threshold, so every phrase that reaches it survives, and two
    phrases of one hash only add to each other. The survivors' hashes set bits of a
    filter. The second pass counts, by their text, the phrases that pass it: a task sums
    what it reads, hash partitions sum the tasks.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = own.agg(F.sum(F.octet_length("text")).alias("n")).collect()[0].n or 0
    # prose has a word in six bytes or so, and each begins a phrase of each length
    mass = max(1, size // 6 * longest)
    part_bits = min(24, max(6, (mass // (part_mass or PART_MASS)).bit_length()))
    filter_bits = max(part_bits + 3, min(filter_bits or FILTER_BITS, max(20, mass.bit_length())))
    sent = own.mapInArrow(_send(part_bits, longest), "part int, keys binary, counts binary, wide boolean")
    slices = sent.groupBy("part").applyInPandas(_survivors(threshold, filter_bits - part_bits), "part int, bits binary").collect()  # 2^filter_bits bits in all
    each = 1 << (filter_bits - part_bits - 3)
    whole = bytearray(each << part_bits)
    for r in slices:
        whole[r.part * each : (r.part + 1) * each] = r.bits
    held = spark.sparkContext.broadcast(bytes(whole))
    counted = own.mapInArrow(_count(filter_bits, part_bits, held, longest), "part int, phrases binary")
    return counted.groupBy("part").applyInArrow(_sum(threshold), "lang string, phrase string, f long")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 3, threshold: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to `longest` words.

    A-Z become lower case, texts are split into pieces at `.,;:!?` and U+000A to U+000D,
    pieces into words at spaces and tabs. a is the phrase's number of occurrences within
    pieces (at least threshold), l and r those of its parts at the cut with the lowest
    score, floor(1000000 a a / (l r)), ties to the earliest cut; n is the language's
    number of words. A phrase goes if a longer one that has it inside occurs at least
    share % as often. Ranks go by score and a descending, then by the phrase's bytes.

    Null texts are empty ones and a null lang is `und`; repeated rows count each, other
    columns play no part, an empty table gives an empty result. Counts below 10^16 are exact.
    """
    counts = materialize(phrase_counts(docs, text_col, lang_col, longest, threshold), "phrases")
    totals = counts.where("phrase = ''").select(F.col("lang").alias("_lang"), F.col("f").alias("n"))
    words = F.split("phrase", " ")
    phrases = counts.where("phrase <> ''").withColumn("words", words)
    longer = phrases.where(F.size("words") > 1)
    part = lambda i, n: F.array_join(F.slice("words", i, n), " ")
    cut = F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda k: F.struct(k.alias("k"), part(F.lit(1), k).alias("left"), part(k + 1, F.size("words") - k).alias("right"))))
    cuts = longer.select("lang", "phrase", F.col("f").alias("a"), cut.alias("c")).select("lang", "phrase", "a", "c.*")
    of = lambda side, out: phrases.select("lang", F.col("phrase").alias(side), F.col("f").alias(out))
    both = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    whole = lambda c: F.col(c).cast("decimal(16,0)")
    both = both.withColumn("score", _score(whole("a"), whole("l"), whole("r")))
    least = both.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("m"))
    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: part(i, n))))
    held = longer.where(F.size("words") > 2).select("lang", F.explode(F.array_distinct(inside)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    stay = least.join(held, ["lang", "phrase"], "left").where("most IS NULL OR 100 * most < %d * a" % share)
    ranked = materialize(stay.select("lang", "phrase", "a", "m.l", "m.r", "m.score"), "scored")
    # a language may have any share of all phrases, so its best are told in groups first
    groups = max(1, ranked.count() // RANK_ROWS)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    first = best(ranked.withColumn("_group", F.pmod(F.xxhash64("phrase"), F.lit(groups))), "lang", "_group").drop("_group", "rank")
    return best(first, "lang").join(totals, F.col("lang") == F.col("_lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _score(a, l, r):  # noqa: E741
    """floor(1000000 a a / (l r)), in decimals of up to 38 digits."""
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (a * a), l * r)


def op12_collocations(docs: DataFrame) -> DataFrame:
    return collocations(docs)


ORACLE = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM p),
g AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w),
c AS (
  SELECT lang, k, ws, array_to_string(ws, ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, k, words[i:i + k - 1] AS ws FROM g, (VALUES (1), (2), (3)) AS s(k) WHERE i + k - 1 <= len(words)) GROUP BY lang, k, ws),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE k = 1 GROUP BY lang),
cand AS (SELECT * FROM c WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT t.lang, t.phrase, t.f AS a, cut, x.f AS l, y.f AS r, (1000000::HUGEINT * t.f * t.f) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM cand) t
  JOIN c x ON x.lang = t.lang AND x.ws = t.ws[1:cut] JOIN c y ON y.lang = t.lang AND y.ws = t.ws[cut + 1:]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (SELECT lang, sub, max(f) AS f FROM (SELECT lang, f, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS sub FROM cand WHERE k = 3) GROUP BY lang, sub),
kept AS (SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.sub = b.phrase WHERE i.f IS NULL OR 100 * i.f < 50 * b.a)
SELECT k.lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) k JOIN n ON n.lang = k.lang WHERE rank <= 2000
"""
