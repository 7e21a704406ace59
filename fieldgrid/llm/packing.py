"""Packing documents into fixed windows of tokens."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, give_back, small_batches, tidy

WINDOW, END_ID = 2048, 1
#: Partially filled windows that a task holds at most; at more, it fills them up by cutting.
MAX_OPEN = 4096
#: Words whose ids a task remembers at most.
MAX_WORDS = 1_000_000
PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordCache:
    """Token ids of texts, by the ids of their stretches between spaces and line ends.

    The tokenizer never joins what white space separates, so a stretch always gets the
    same ids; each is encoded once.
    """

    def __init__(self, path: str):
        import numpy as np
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        give_back()  # reading the file takes much
        self.np, self.seen, self.flat, self.ends = np, {}, np.zeros(0, "<u4"), np.zeros(1, "int64")
        #: Whether an id ends a unit of the tokenizer.
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]] = True

    def encode(self, texts) -> list:
        """The ids of each text of an Arrow array."""
        import pyarrow.compute as pc

        np = self.np
        if len(self.seen) > MAX_WORDS:
            self.seen, self.flat, self.ends = {}, np.zeros(0, "<u4"), np.zeros(1, "int64")
        parted = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        ends = parted.value_lengths().to_numpy(zero_copy_only=False).cumsum()
        coded = parted.flatten().dictionary_encode()
        own = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn([w for w in own if w not in self.seen])
        numbers = np.fromiter(map(self.seen.__getitem__, own), "int64", len(own))
        at = numbers[coded.indices.to_numpy()]
        first, n = self.ends[at], self.ends[at + 1] - self.ends[at]
        upto = np.cumsum(n)
        ids = self.flat[np.repeat(first - upto + n, n) + np.arange(upto[-1] if len(upto) else 0)]
        return np.split(ids, np.append(0, upto)[ends[:-1]])

    def _learn(self, new: list[str]) -> None:
        np = self.np
        plain, other, found = [], [], []
        for w in new:
            if w.isascii() and w.isalpha():
                plain.append((w, 1))
                continue
            core = w.rstrip(".,;:!?")
            # letters alone are one unit of the tokenizer, marks at the end another
            (plain if core.isalpha() and w.lower()[: len(core)].isalpha() and len(w.lower()) == len(w) else other).append((w, 1 + (len(core) < len(w))))
        for lo in range(0, len(plain), 4000):
            parts = [plain[k : k + 200] for k in range(lo, min(lo + 4000, len(plain)), 200)]
            for part, encoded in zip(parts, self.tokenizer.encode_batch_fast([" ".join([w for w, _ in part]) for part in parts], add_special_tokens=False)):
                ids = np.array(encoded.ids, "<u4")
                units, last = np.cumsum([k for _, k in part]), np.nonzero(self.last[ids])[0] + 1
                if len(last) == units[-1]:
                    found.append(([w for w, _ in part], ids, last[units - 1]))
                else:
                    other += part
        if other:
            each = [e.ids for lo in range(0, len(other), 4000) for e in self.tokenizer.encode_batch_fast([w for w, _ in other[lo : lo + 4000]], add_special_tokens=False)]
            found.append(([w for w, _ in other], np.fromiter((i for x in each for i in x), "<u4"), np.cumsum([len(x) for x in each], dtype="int64")))
        ends, size = [self.ends], len(self.flat)
        for words, ids, last in found:
            self.seen.update(zip(words, range(len(self.seen), len(self.seen) + len(words))))
            ends.append(size + last)
            size += len(ids)
        self.ends, self.flat = np.concatenate(ends), np.concatenate([self.flat, *[ids for _, ids, _ in found]])


class SumOfSquares:
    """Online packing: a remainder goes to the level of fill after which the sum of squared counts of levels is least.

    level[h] counts the open windows filled to h. Ties go to the fullest window.
    """

    def __init__(self, window: int, first_sequence: int):
        import numpy as np

        self.np, self.window, self.next = np, window, first_sequence
        self.level = np.zeros(window + 1, "int64")
        self.open: dict[int, list] = {}
        self.n_open = 0
        self.done: list[tuple] = []

    def _close(self, pieces: list) -> None:
        at = 0
        for p in pieces:
            self.done.append((*p, self.next, at))
            at += p[2]
        self.next += 1

    def add(self, doc, n: int) -> None:
        """A document of n tokens: whole windows of its own first, then the rest."""
        np, w = self.np, self.window
        full = n - n % w
        for start in range(0, full, w):
            self._close([(doc, start, w)])
        s = n - full
        if not s:
            return
        leaves = 1 - 2 * self.level[: w - s + 1]
        leaves[0] = 0
        arrives = 2 * self.level[s:] + 1
        arrives[-1] = 0
        change = np.where((self.level[: w - s + 1] > 0) | (np.arange(w - s + 1) == 0), leaves + arrives, np.iinfo("int64").max)
        h = w - s - int(np.argmin(change[::-1]))
        pieces = self.open[h].pop() if h else []
        self.n_open -= h > 0
        self.level[h] -= h > 0
        pieces.append((doc, full, s))
        if h + s == w:
            self._close(pieces)
            return
        self.level[h + s] += 1
        self.n_open += 1
        self.open.setdefault(h + s, []).append(pieces)
        if self.n_open > MAX_OPEN:
            self.fill_up(last=False)

    def fill_up(self, last: bool) -> None:
        """Fills the fullest windows from the emptiest, cutting where need be; one window is left.

        At the end, what it holds becomes sequences of powers of two, which need no padding.
        """
        windows = [(h, x) for h in sorted(self.open, reverse=True) for x in self.open[h]]
        self.open, self.n_open = {}, 0
        self.level[:] = 0
        i, j = 0, len(windows) - 1
        while i < j:
            (a, to), (b, of) = windows[i], windows[j]
            doc, start, n = of.pop()
            take = min(self.window - a, n)
            to.append((doc, start + n - take, take))
            if take < n:
                of.append((doc, start, n - take))
            windows[i], windows[j] = (a + take, to), (b - take, of)
            if a + take == self.window:
                self._close(to)
                i += 1
            if not of:
                j -= 1
        if i == j:
            h, pieces = windows[i]
            if not last:
                self.open, self.n_open = {h: [pieces]}, 1
                self.level[h] = 1
                return
            while h:
                size = 1 << (h.bit_length() - 1)
                part, left = [], size
                while left:
                    doc, start, n = pieces.pop(0)
                    take = min(left, n)
                    part.append((doc, start, take))
                    left -= take
                    if take < n:
                        pieces.insert(0, (doc, start + take, n - take))
                self._close(part)
                h -= size


def _pack(tokenizer_path: str, window: int):
    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        words, docs, n = WordCache(tokenizer_path), {}, 0
        packer = SumOfSquares(window, TaskContext.get().partitionId() << 32)

        def ready(schema):
            """The rows of the pieces whose windows are closed; documents without open pieces are forgotten."""
            rows, packer.done = packer.done, []
            pieces = [[], [], [], [], [], []]
            for doc, start, length, sequence, offset in rows:
                _, ids, first, total, _ = docs[doc]
                for to, x in zip(pieces, (start, length, zlib.crc32(ids[start - first : start - first + length].tobytes()), total, sequence, offset)):
                    to.append(x)
            carried = [pa.array([docs[x[0]][0][i] for x in rows], f.type) for i, f in enumerate(schema)]
            closed = {x[0] for x in rows}
            for doc, _, length, _, _ in rows:
                docs[doc][4] -= length
            for doc in closed:
                own = docs[doc]
                if not own[4]:
                    del docs[doc]
                elif own[3] - own[2] > window:  # whole windows are out: only the rest waits
                    first = own[3] - own[3] % window
                    own[1:3] = own[1][first - own[2] :].copy(), first
            return pa.RecordBatch.from_arrays([*carried, *[pa.array(x, pa.int64()) for x in pieces]], names=[*schema.names, *[x.split()[0] for x in PIECE.split(", ")]])

        schema = None
        for batch in batches:
            carried = batch.select([c for c in batch.schema.names if c != "_text"])
            schema = carried.schema
            for part in byte_slices(batch, "_text", 3 << 20):
                own = list(zip(*[part.column(part.schema.names.index(c)).to_pylist() for c in schema.names])) if len(schema) else [()] * part.num_rows
                for row, ids in zip(own, words.encode(part.column(part.schema.names.index("_text")))):
                    ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                    # columns, ids, the place of their first, tokens, tokens in open windows
                    docs[n] = [row, ids, 0, len(ids), len(ids)]
                    packer.add(n, len(ids))
                    n += 1
                yield ready(schema)
        packer.fill_up(last=True)
        if schema is not None:
            yield ready(schema)

    return tidy(run)


def pack(docs: DataFrame, tokenizer_path: str, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """A row for each piece of each document: docs' columns but the text, and start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are the tokenizer's, then END_ID. Whole windows are cut off first;
    the rest goes where sum-of-squares packing puts it, in the task that reads the
    document, so nothing is shuffled. Windows that stay partially filled at a task's end
    are filled from each other by cutting; a task's last tokens become at most 11
    sequences of powers of two, so no sequence needs padding. The number of
    partially filled windows that a task holds is bounded by MAX_OPEN, and so is its memory.
    sequence_id is unique: the partition's number times 2**32, plus a number in the partition.

    Null and empty texts are END_ID alone. Repeated rows are documents of their own, null
    ids pass through, an empty table gives an empty result. Columns named as the result's
    are replaced; names that start with _ are reserved.
    """
    small_batches(docs.sparkSession)
    new = [x.split()[0] for x in PIECE.split(", ")]
    keep = [c for c in docs.columns if c != text_col and c not in new]
    given = docs.select(*keep, F.col(text_col).alias("_text"))
    schema = given.drop("_text").schema
    for x in PIECE.split(", "):
        schema = schema.add(x.split()[0], "long")
    return given.mapInArrow(_pack(tokenizer_path, window), schema)


def op5_packing(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    return pack(docs.select("doc_id", "text"), tokenizer_path)
