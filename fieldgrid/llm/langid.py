"""Language identification by unigram pieces, summed over all segmentations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, fold, materialize, small_batches, tidy

#: Documents of each language that the fit reads at most (about: they are chosen by a hash of their ids).
FIT_DOCS = 1500
ROUNDS = 2
#: Characters after which running products are brought back to 1, so that they stay within a double's range.
RESCALE = 16
#: Bytes of running sums at once, and words whose likelihoods a task remembers.
SUM_BYTES, MAX_WORDS = 2 << 20, 200_000
#: The share of a piece that a language doesn't have, and that of a character that no piece has.
SMOOTHING, UNKNOWN = 0.05, 1e-8
UNDETERMINED = "und"


def vocabulary(path: str) -> list[str]:
    """The public pieces in lower case, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return sorted({p for p in map(model.id_to_piece, ids) if p == p.lower()})


def runs_of(texts):
    """(runs, numbers, ends) of an Arrow array of texts: the different words in lower case, marked at the front as the vocabulary marks them, and each text's words by their numbers."""
    import numpy as np
    import pyarrow.compute as pc

    words = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    coded = words.flatten().dictionary_encode()
    own, number = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
    text = np.repeat(np.arange(len(texts)), words.value_lengths().to_numpy())
    if "" in own:  # white space at a text's ends
        there = number != own.index("")
        number, text = number[there], text[there]
    return ["▁" + w for w in own], number, np.cumsum(np.bincount(text, minlength=len(texts)))


class Pieces:
    """Finds the pieces at each place of many runs at once, through a hash table of the pieces' prefixes."""

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self, pieces: list[str]):
        import numpy as np

        self.np = np
        size = np.fromiter(map(len, pieces), "int64", len(pieces))
        self.longest = int(size.max(initial=1))
        codes = np.zeros((len(pieces), size.max(initial=0)), "uint64")
        for i, piece in enumerate(pieces):
            codes[i, : len(piece)] = [ord(c) for c in piece]
        h, prefixes = np.zeros(len(pieces), "uint64"), [np.zeros(0, "uint64")]
        with np.errstate(over="ignore"):
            for j in range(codes.shape[1]):
                h = np.where(size > j, self._step(h, codes[:, j]), h)
                prefixes.append(h[size > j])
        keys = np.unique(np.concatenate(prefixes))
        values = np.full(len(keys), -1, "int32")
        values[np.searchsorted(keys, h)] = np.arange(len(pieces))
        self.tables, bits = [], 20
        while len(keys):
            slot = self._slot(keys, len(self.tables), bits)
            _, first = np.unique(slot, return_index=True)
            key, value = np.zeros(1 << bits, "uint64"), np.full(1 << bits, -2, "int32")
            key[slot[first]], value[slot[first]] = keys[first], values[first]
            self.tables.append((bits, key, value))
            keys, values, bits = np.delete(keys, first), np.delete(values, first), max(8, bits - 4)

    def _step(self, h, c):
        np = self.np
        h = (h ^ c) * np.uint64(self.BASE)
        return h ^ (h >> np.uint64(31))

    def _slot(self, keys, k, bits):
        np = self.np
        return ((keys * np.uint64(0xD6E8FEB86659FD93 + 2 * k)) >> np.uint64(64 - bits)).astype("int64")

    def find(self, h):
        """The piece's number, -1 for a mere prefix, -2 for neither."""
        np = self.np
        left = np.arange(len(h))
        out = np.full(len(h), -2, "int32")
        for k, (bits, key, value) in enumerate(self.tables):
            own = h[left]
            at = self._slot(own, k, bits)
            hit = key[at] == own
            out[left[hit]] = value[at[hit]]
            left = left[~hit]
        return out

    def matches(self, codes, starts):
        """(start, length, rows, pieces) of all pieces in runs of one length that begin at the starts, in their order."""
        np, n = self.np, codes.shape[1]
        for i in starts:
            rows, h = np.arange(len(codes)), np.zeros(len(codes), "uint64")
            for length in range(1, n - i + 1):
                with np.errstate(over="ignore"):
                    h = self._step(h, codes[rows, i + length - 1])
                got = self.find(h)
                if length == 1 and (bare := got < 0).any():
                    yield i, 1, rows[bare], None
                if (hit := got >= 0).any():
                    yield i, length, rows[hit], got[hit]
                live = got > -2
                rows, h = rows[live], h[live]
                if not len(rows):
                    break

    def by_length(self, runs: list[str], row_bytes):
        """(numbers of the runs, their code points) for each length n, as many at once as SUM_BYTES allow at row_bytes(n) each."""
        np = self.np
        sizes = np.fromiter(map(len, runs), "int64", len(runs))
        for n in np.unique(sizes):
            at = np.nonzero(sizes == n)[0]
            step = max(1, SUM_BYTES // row_bytes(int(n)))
            for lo in range(0, len(at), step):
                own = at[lo : lo + step]
                codes = np.frombuffer("".join(runs[i] for i in own).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(own), n)
                yield own, codes.astype("uint64")

    def log_likelihood(self, runs: list[str], p):
        """log of the sum, over all segmentations, of the product of the pieces' probabilities; a column for each column of p.

        Only the sums that pieces can still reach are held, whatever a run's length.
        """
        np, ring, width = self.np, self.longest + 1, p.shape[1]
        out = np.zeros((len(runs), width))
        # languages in blocks, lest a few long rows of sums outgrow SUM_BYTES
        block = max(1, SUM_BYTES // (8 * ring * 64))
        for lo in range(0, width, block):
            q = np.ascontiguousarray(p[:, lo : lo + block])
            for own, codes in self.by_length(runs, lambda n, w=q.shape[1]: 8 * ring * w + 8 * n):
                n, scale, last = codes.shape[1], np.zeros((len(own), q.shape[1])), 0
                ahead = np.zeros((ring, len(own), q.shape[1]))
                ahead[0] = 1
                for i, length, rows, piece in self.matches(codes, range(n)):
                    if i > last:
                        ahead[last % ring] = 0  # the place becomes that of last + ring
                        last = i
                        if i % RESCALE == 0:
                            s = ahead[i % ring].copy()
                            ahead /= s
                            scale += np.log(s)
                    ahead[(i + length) % ring][rows] += ahead[i % ring][rows] * (UNKNOWN if piece is None else q[piece])
                out[own, lo : lo + block] = np.log(ahead[n % ring]) + scale
        return out

    def expected(self, runs: list[str], weight, p):
        """Expected counts of the pieces in weighted runs under the probabilities p, by the forward and backward sums."""
        np = self.np
        out = np.zeros(len(p))
        for own, codes in self.by_length(runs, lambda n: 40 * (n + 1)):
            n = codes.shape[1]
            # sums, and the logs of what they are divided by
            forward, back = np.zeros((n + 1, len(own))), np.zeros((n + 1, len(own)))
            before, after = np.zeros((n + 1, len(own))), np.zeros((n + 1, len(own)))
            forward[0], back[n], last = 1, 1, 0
            found = list(self.matches(codes, range(n))) if n <= 64 else None
            for i, length, rows, piece in found or self.matches(codes, range(n)):
                if i > last:
                    last = i
                    if i % RESCALE == 0:
                        part = slice(i, i + self.longest + RESCALE + 1)
                        s = forward[i].copy()
                        forward[part] /= s
                        before[part] = before[i] + np.log(s)
                forward[i + length][rows] += forward[i][rows] * (UNKNOWN if piece is None else p[piece])
            total, last = np.log(forward[n]) + before[n], n
            for i, length, rows, piece in reversed(found) if found else self.matches(codes, range(n - 1, -1, -1)):
                if i < last:
                    # sums at `last` are whole
                    if last % RESCALE == 0 and last < n:
                        part = slice(max(0, last - self.longest - RESCALE), last + 1)
                        s = back[last].copy()
                        back[part] /= s
                        after[part] = after[last] + np.log(s)
                    last = i
                own_p = UNKNOWN if piece is None else p[piece]
                term = back[i + length][rows] * own_p
                if n > RESCALE:  # what comes after a piece may have been scaled less often than what stands at its start
                    term *= np.exp(after[i + length][rows] - after[i][rows])
                back[i][rows] += term
                if piece is not None:
                    share = forward[i][rows] * term * (np.exp(before[i][rows] + after[i][rows] - total[rows]) if n > RESCALE else 1 / forward[n][rows])
                    out += np.bincount(piece, weight[own][rows] * share, len(p))
        return out


def _count_runs(batches):
    """How often each language has each run."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for part in byte_slices(batch, "text"):
            runs, number, ends = runs_of(part.column(part.schema.names.index("text")))
            lang = part.column(part.schema.names.index("lang")).dictionary_encode()
            of = np.repeat(lang.indices.to_numpy(), np.diff(np.append(0, ends)))
            pair, n = np.unique(of.astype("int64") * max(1, len(runs)) + number, return_counts=True)
            at = pair // max(1, len(runs))
            yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(at)), pa.array([runs[i] for i in pair % max(1, len(runs))], pa.string()), pa.array(n.astype("int64"))], names=["lang", "run", "n"])


def _expect(pieces, languages, p):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        finder, total = Pieces(pieces), np.zeros((len(pieces), len(languages)))
        for batch in batches:
            for j, lang in enumerate(languages):
                own = batch.filter(pc.equal(batch.column(0), lang))
                if own.num_rows:
                    total[:, j] += finder.expected(own.column(1).to_pylist(), own.column(2).to_numpy().astype(float), np.ascontiguousarray(p[:, j]))
        piece, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece.astype("int32")), pa.array(j.astype("int32")), pa.array(total[piece, j])], names=["piece", "language", "c"])

    return tidy(run)


def fit(docs: DataFrame, pieces: list[str], fit_docs: int = FIT_DOCS, rounds: int = ROUNDS):
    """(languages, probabilities: pieces x languages) from docs(doc_id, text, lang).

    Expectation-maximisation over all segmentations. Each language gives about fit_docs
    documents at most, chosen by a hash of their ids; what reaches the driver is a count
    for each piece and language, of which the model has one double each, whatever the
    corpus. Rows with a null text or lang are left out.
    """
    import numpy as np

    small_batches(docs.sparkSession)
    labelled = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return [], np.zeros((len(pieces), 0))
    million = 1_000_000
    cut = F.create_map(*[F.lit(x) for lang in languages for x in (lang, max(1, min(million, million * fit_docs // counts[lang])))])
    sample = labelled.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(million)) < cut[F.col("lang")])
    runs = materialize(sample.select("lang", "text").mapInArrow(tidy(_count_runs), "lang string, run string, n long").groupBy("lang", "run").agg(F.sum("n").alias("n")), "runs")
    p = np.full((len(pieces), len(languages)), 1 / len(pieces))
    for _ in range(rounds):
        rows = runs.select("lang", "run", "n").mapInArrow(_expect(pieces, languages, p), "piece int, language int, c double").groupBy("piece", "language").agg(F.sum("c").alias("c")).toPandas()
        c = np.zeros_like(p)
        c[rows["piece"].to_numpy(), rows["language"].to_numpy()] = rows["c"].to_numpy()
        # sums of doubles differ in their last places from run to run
        c = np.round(c, 6) + SMOOTHING
        p = c / c.sum(axis=0)
    return languages, p


def _score(pieces, languages, p, text_col, keep):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        finder, known, likely = Pieces(pieces), {}, np.zeros((0, len(languages)))
        for batch in batches:
            for part in byte_slices(batch, text_col):
                col = {c: part.column(i) for i, c in enumerate(part.schema.names)}
                runs, number, ends = runs_of(col[text_col])
                if len(known) > MAX_WORDS:
                    known, likely = {}, likely[:0]
                new = [r for r in runs if r not in known]
                known.update(zip(new, range(len(known), len(known) + len(new))))
                likely = np.concatenate([likely, finder.log_likelihood(new, p)])
                at = np.fromiter(map(known.__getitem__, runs), "int64", len(runs))[number]
                letters = np.append(0, np.cumsum(np.fromiter((any(map(str.isalpha, r)) for r in runs), bool, len(runs))[number]))
                starts = np.append(0, ends[:-1])
                pred, score = [UNDETERMINED] * part.num_rows, np.zeros(part.num_rows)
                for i in np.nonzero(letters[ends] > letters[starts])[0].tolist() if languages else ():
                    # at most so many words at once, lest many languages take much memory
                    step = max(1, SUM_BYTES // (8 * len(languages)))
                    total = sum(likely[at[lo : min(lo + step, ends[i])]].sum(axis=0) for lo in range(starts[i], ends[i], step))
                    best = int(total.argmax())
                    pred[i], score[i] = languages[best], 1 / np.exp(total - total[best]).sum()
                yield pa.RecordBatch.from_arrays([*[col[c] for c in keep], pa.array(pred, pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    return tidy(run)


def identify(docs: DataFrame, model, pieces: list[str], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (of its columns only keep, if given) with lang_pred and score.

    The score is the posterior probability of the language under equal priors. A text
    that is null or has no letter (Unicode category L) is `und` with score 0, and so is
    all text if no language was learned; ties go to the first language by code point.
    Whole texts count. Other columns pass through; lang_pred and score are replaced if
    present. Empty tables give empty results, repeated rows repeated results.
    """
    small_batches(docs.sparkSession)
    languages, p = model
    given = docs.select(*[c for c in docs.columns if c not in ("lang_pred", "score")])
    keep = given.columns if keep is None else keep
    schema = given.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return given.select(*dict.fromkeys([*keep, text_col])).mapInArrow(_score(pieces, languages, p, text_col, keep), schema)


def held_out(doc_id: Column) -> Column:
    """Whether the row is kept from the fit; null ids are."""
    return F.coalesce(fold(doc_id, 4) == 2, F.lit(True))


def fitted(docs: DataFrame, vocabulary_path: str | None = None):
    """(model, pieces) learned from the rows that aren't held out."""
    if vocabulary_path is None:
        import public_tokenizers

        vocabulary_path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = vocabulary(vocabulary_path)
    return fit(docs.where(~held_out(F.col("doc_id"))), pieces), pieces


def op6_langid(docs: DataFrame) -> DataFrame:
    model, pieces = fitted(docs)
    return identify(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model, pieces, keep=["doc_id", "held_out"])
