"""Toxicity scores from a learned lexicon that also catches misspelled terms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, materialize, small_batches

#: Documents of each label that the fit reads at most (about: they are chosen by a hash of their ids).
FIT_DOCS = 20_000
#: A term is so many times likelier in toxic documents than in others (a stem, in the second place). Its log-likelihood ratio statistic is at least 2 log(candidates), beyond which about one of so many would come by chance.
MIN_RATIO, MIN_STEM_RATIO = 12.0, 4.0
#: Shared beginnings of words count as terms at these lengths, if at least MIN_FORMS words have them.
STEM_CHARS, MIN_FORMS = range(3, 9), 4
#: Terms of this length also match at edit distance 1.
FUZZY_CHARS = 5
#: Marks that open a quotation before a word, each with those that close it after one.
QUOTES = {'"': '"', "“": "”", "«": "»", "»": "«", "„": "“”", "‘": "’", "'": "'", "‹": "›", "›": "‹", "‚": "‘’"}
#: Before any hits of a kind are seen, the toxic documents with one number this share of those with the plain term, and the others this many.
PRIOR = {"plain": (1.0, 0.5), "stem": (1.0, 0.5), "fuzzy": (0.2, 0.5), "quoted": (0.02, 1.0)}
#: No hit weighs more, in natural logarithms of odds.
MAX_WEIGHT = 8.0
#: The log odds of a text without hits are no less, so that one plain hit of a sure term suffices.
MIN_BASE = -6.5
THRESHOLD = 0.7
QUOTE_MARKS = "".join(sorted({*QUOTES, *"".join(QUOTES.values())}))
STRIP = ".,;:!?()[]{}…-–—*_/\\|" + QUOTE_MARKS
#: Least hashes of words in threes that near copies share in one of two sets, and of a set.
COPY_HASHES = 6


def word_of(token: str) -> str:
    return token.strip(STRIP)


class Automaton:
    """The Levenshtein automata of distance 1, intersected with a trie of terms and made deterministic as words need it.

    A state is a set of pairs (node of the trie, edits so far). Terms under FUZZY_CHARS
    accept no edit. A complete stem stays in the state as (-1 - its node, 0), whatever
    follows; a term of the whole word comes before it, and a misspelling after.
    """

    MAX_STATES = 200_000

    def __init__(self, terms: list[str], stems: list[str]):
        self.children: list[dict] = [{}]
        self.term: dict[int, str] = {}
        self.stem: dict[int, str] = {}
        for words, to in ((terms, self.term), (stems, self.stem)):
            for w in words:
                node = 0
                for c in w:
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                    node = self.children[node][c]
                to[node] = w
        self.letters = {c for x in self.children for c in x}
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.sets, self.moves, self.ends = {}, [], [], []
        self.start = self._number(frozenset([(0, 0)]))

    def _number(self, state: frozenset) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.sets)
            self.sets.append(state)
            self.moves.append({})
            self.ends.append(self._end(state))
        return self.numbers[state]

    def _end(self, state):
        """(kind, term) that a word ending here matches."""
        exact = [self.term[n] for n, e in state if e == 0 and n in self.term]
        if exact:
            return "plain", exact[0]
        stems = [self.stem[-1 - n] for n, _ in state if n < 0]
        if stems:
            return "stem", max(stems, key=lambda x: (len(x), x))
        near = [self.term[n] for n, e in state if e == 1 and n in self.term and len(self.term[n]) >= FUZZY_CHARS]
        near += [self.term[m] for n, e in state if e == 0 and n >= 0 for m in self.children[n].values() if m in self.term and len(self.term[m]) >= FUZZY_CHARS]
        return ("fuzzy", min(near)) if near else None

    def _move(self, state: int, c: str):
        out = set()
        for n, e in self.sets[state]:
            if n < 0:
                out.add((n, e))
                continue
            below = self.children[n]
            if c in below:
                out.add((below[c], e))
                if e == 0 and below[c] in self.stem:
                    out.add((-1 - below[c], 0))
            if e == 0:
                out.add((n, 1))
                for m in below.values():
                    out.add((m, 1))
                    if c in self.children[m]:
                        out.add((self.children[m][c], 1))
        # what no term can be reached from is dropped
        return self._number(frozenset(x for x in out if x[0] < 0 or self.children[x[0]] or x[0] in self.term))

    def match(self, word: str):
        """(kind, term), kind being plain, fuzzy or stem, or None."""
        if len(self.sets) > self.MAX_STATES:
            self._forget()
        state = self.start
        for c in word:
            c = c if c in self.letters else ""
            to = self.moves[state].get(c)
            if to is None:
                to = self.moves[state][c] = self._move(state, c)
            if not self.sets[to]:
                return None
            state = to
        return self.ends[state]


def quoted_at(tokens: list[str]) -> list[bool]:
    """Whether each token of a line is in a quotation: from a word that a mark opens to the first that its like closes."""
    out, opened, closing = [False] * len(tokens), None, ""
    for i, t in enumerate(tokens):
        core = t.strip(STRIP)
        # marks alone open, or else close
        before, after = (t[: t.find(core)], t[t.find(core) + len(core) :]) if core else (t, "") if opened is None else ("", t)
        if opened is None:
            mark = next((c for c in before if c in QUOTES), None)
            if mark is None:
                continue
            opened, closing = i, QUOTES[mark]
        if any(c in closing for c in after):
            out[opened : i + 1] = [True] * (i + 1 - opened)
            opened = None
    return out


def hits(text: str, known: dict, automaton: Automaton) -> list[tuple[str, str, str]]:
    """(kind, term, word) of each term in the text; a hit in a quotation of its line is of kind quoted. known: what words matched so far."""
    out = []
    for line in text.lower().split("\n"):
        tokens = line.split()
        found = []
        for i, t in enumerate(tokens):
            if t in known:
                own = known[t]
            else:
                own = known[t] = automaton.match(word_of(t))
            if own:
                found.append((i, own))
        if found:
            quoted = quoted_at(tokens)
            out += [("quoted" if quoted[i] else own[0], own[1], word_of(tokens[i])) for i, own in found]
    return out


def _features(batches):
    """word and stem document counts by label."""
    import collections

    import pandas as pd

    for pdf in batches:
        n = collections.Counter()
        for text, toxic in zip(pdf["text"], pdf["toxic"]):
            words = {w for w in map(word_of, text.lower().split()) if len(w) > 2}
            n.update((w, False, toxic) for w in words)
            n.update((s, True, toxic) for s in {w[:k] for w in words for k in STEM_CHARS if len(w) >= k and w[:k].isalpha()})
        yield pd.DataFrame([(w, stem, k if t else 0, 0 if t else k) for (w, stem, t), k in n.items()], columns=["term", "is_stem", "toxic", "other"])


def _by_hit(found: list) -> dict:
    """The different words of each (kind, term)."""
    out: dict = {}
    for kind, term, word in found:
        out.setdefault((kind, term), set()).add(word)
    return out


def _signed(batches):
    """Adds two hashes, each of COPY_HASHES independent least hashes of the text's words in threes; near copies tend to share one."""
    import numpy as np
    import xxhash

    salts = np.array([xxhash.xxh3_64_intdigest(bytes([k])) | 1 for k in range(2 * COPY_HASHES)], "uint64")
    for pdf in batches:
        found = []
        for text in pdf["text"]:
            words = text.lower().split()
            h = np.array([xxhash.xxh3_64_intdigest(" ".join(words[i : i + 3]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(words) - 2))], "uint64")
            h = h * salts[:, None]
            least = ((h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)).min(axis=1)
            found.append([xxhash.xxh3_64_intdigest(x.tobytes()) - 2**63 for x in np.split(least, 2)])
        yield pdf.assign(_a=[x[0] for x in found], _b=[x[1] for x in found])


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> dict:
    """The lexicon and the weights of its hits, from docs(doc_id, text) and labels(doc_id, toxic).

    About fit_docs documents of each label at most are read, chosen by a hash of their
    ids. Near copies of one label among them count once, that of the smallest id, lest
    the words of one text that was copied pass for terms. What reaches the driver are the
    terms that these documents hold, and a count for each kind of hit: fit_docs bounds
    both. An id with both labels is toxic; null ids and other labels are left out.
    """
    small_batches(docs.sparkSession)
    labels = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    million = 1_000_000
    cut = F.when(F.col("toxic") == 1, F.lit(min(million, million * fit_docs // max(1, counts.get(1, 1))))).otherwise(F.lit(min(million, million * fit_docs // max(1, counts.get(0, 1)))))
    chosen = materialize(labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(million)) < cut), "chosen-labels")
    sample = docs.where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")  # at most about 2 * fit_docs rows
    sample = sample.select("doc_id", "text", "toxic")
    signed = sample.mapInPandas(_signed, sample.select("*").schema.add("_a", "long").add("_b", "long"))
    signed = materialize(signed.groupBy("doc_id", "toxic", "_a", "_b").agg(F.min("text").alias("text")), "signed")
    for mark in ("_a", "_b"):
        first = signed.groupBy("toxic", mark).agg(F.min("doc_id").alias("doc_id"))
        signed = signed.join(F.broadcast(first), ["toxic", mark, "doc_id"], "left_semi")  # at most as many rows as the sample
    sample = materialize(signed.select("doc_id", "text", "toxic"), "fit-docs")
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    model = {"terms": [], "stems": [], "weights": {}, "base": -10.0}
    if not n1:
        return model
    table = sample.select("text", "toxic").mapInPandas(_features, "term string, is_stem boolean, toxic long, other long").groupBy("term", "is_stem").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    ratio = ((F.col("toxic") + 0.5) / (n1 + 1)) / ((F.col("other") + 0.5) / (n0 + 1))
    table = materialize(table.where(F.col("toxic") > 0), "terms")
    both, share = F.col("toxic") + F.col("other"), n1 / (n1 + n0)
    part = lambda c, p: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (both * F.lit(max(p, 1e-12))))).otherwise(0.0)
    statistic = 2 * (part("toxic", share) + part("other", 1 - share))
    least = 2 * math.log(max(2, table.count()))
    good = table.where((ratio >= F.when(F.col("is_stem"), MIN_STEM_RATIO).otherwise(MIN_RATIO)) & (statistic >= least)).collect()
    words = {r["term"]: r["toxic"] for r in good if not r["is_stem"]}
    stems = {r["term"]: r["toxic"] for r in good if r["is_stem"]}
    # a stem stands for its words if they are many; of nested ones, the longest that keeps nearly all of the support
    forms = table.where(~F.col("is_stem")).select("term", F.explode(F.array(*[F.substring("term", 1, k) for k in STEM_CHARS])).alias("stem")).where(F.char_length("term") > F.char_length("stem"))
    asked = docs.sparkSession.createDataFrame([(x,) for x in stems], "stem string")
    n_forms = {r["stem"]: r["n"] for r in forms.join(F.broadcast(asked), "stem").groupBy("stem").agg(F.countDistinct("term").alias("n")).collect()}
    longer, most = {}, {}
    for x in stems:
        if n_forms.get(x, 0) >= MIN_FORMS and stems[x] >= 0.9 * stems.get(x[:-1], 0):
            longer.setdefault(x[:-1], x)
    for w, k in words.items():
        for i in STEM_CHARS:
            most[w[:i]] = max(k, most.get(w[:i], 0))
    chosen_stems: set[str] = set()
    for s in sorted(stems, key=lambda x: (len(x), x)):
        if n_forms.get(s, 0) < MIN_FORMS or any(s[:i] in chosen_stems for i in STEM_CHARS):
            continue
        while s in longer:
            s = longer[s]
        # one word and its few variants are no stem
        if most.get(s, 0) < 0.5 * stems[s]:
            chosen_stems.add(s)
    model["stems"] = sorted(chosen_stems)
    model["terms"] = sorted(words)
    # the words of a stem have many neighbours, so what is near one is no misspelling of it
    stemmed = {w for w in words if any(w[:i] in chosen_stems for i in STEM_CHARS)}
    seen = sample.select("text", "toxic").mapInPandas(_kinds(model), "kind string, term string, toxic long, other long").groupBy("kind", "term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).collect()
    got = {(r["kind"], r["term"]): (r["toxic"], r["other"]) for r in seen}
    # other documents with a misspelling of any term, for each: what one term alone is too rare to tell
    stray = sum(o for (kind, term), (_, o) in got.items() if kind == "fuzzy" and term not in stemmed) / max(1, len(words) - len(stemmed))
    for term in [*model["terms"], *model["stems"]]:
        base_kind = "stem" if term in chosen_stems else "plain"
        plain = got.get((base_kind, term), (0, 0))[0]
        for kind in (base_kind, "quoted") if term in stemmed else (base_kind, "fuzzy", "quoted"):
            (share, other), (t, o) = PRIOR[kind], got.get((kind, term), (0, 0))
            t = t + 0.5 if kind == base_kind else t + share * plain
            model["weights"][kind, term] = max(-MAX_WEIGHT, min(MAX_WEIGHT, math.log((t + 0.01) / (n1 + 1)) - math.log((o + other + (stray if kind == "fuzzy" else 0)) / (n0 + 1))))
    t, o = got.get(("none", None), (0, 0))
    model["base"] = max(MIN_BASE, 1 - math.log(2 * (n0 + 1)), math.log((t + 0.05) / (o + 1)))
    return model


def _kinds(model):
    def run(batches):
        """Documents by label with each kind of hit of each term, and without any."""
        import collections

        import pandas as pd

        automaton, known = Automaton(model["terms"], model["stems"]), {}
        for pdf in batches:
            n = collections.Counter()
            for text, toxic in zip(pdf["text"], pdf["toxic"]):
                n.update((k, t, toxic) for k, t in _by_hit(hits(text, known, automaton)) or {("none", None): 0})
            yield pd.DataFrame([(k, term, c if t else 0, 0 if t else c) for (k, term, t), c in n.items()], columns=["kind", "term", "toxic", "other"])

    return run


def _score(model):
    def run(batches):
        import math

        import pyarrow as pa

        automaton, known, weights = Automaton(model["terms"], model["stems"]), {}, model["weights"]
        for batch in batches:
            score, n_hits = [], []
            for text in batch.column(batch.schema.names.index("_text")).to_pylist():
                if len(known) > 300_000:
                    known.clear()
                found = hits(text, known, automaton) if text else []
                # a stem counts for up to three different words, anything else once
                odds = model["base"] + sum(weights.get(hit, 0.0) * min(3, len(words) if hit[0] == "stem" else 1) for hit, words in sorted(_by_hit(found).items()))
                score.append(1 / (1 + math.exp(-max(-50.0, min(50.0, odds)))))
                n_hits.append(len(found))
            keep = [i for i, c in enumerate(batch.schema.names) if c != "_text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array(score, pa.float64()), pa.array(n_hits, pa.int64())], names=[*[batch.schema.names[i] for i in keep], "score", "n_hits"])

    return run


def score_toxicity(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and n_hits.

    The odds of a text without hits are multiplied by the ratio of rates, in toxic and
    in other documents, of each different hit: a term, a misspelling of it, a word with
    its stem, or one of them in quotation. Null and empty texts have the score of texts without a hit. Whole texts
    count, repeated hits once. Other columns pass through; score and n_hits are replaced
    if present.
    """
    small_batches(docs.sparkSession)
    given = docs.select(*[c for c in docs.columns if c not in ("score", "n_hits")], F.col(text_col).alias("_text"))
    return given.mapInArrow(_score(model), given.drop("_text").schema.add("score", "double").add("n_hits", "long"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id, 3) == 1, F.lit(True))


def op8_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs.select("doc_id", "text"), labels.where(~held_out(F.col("doc_id"))))
    scored = score_toxicity(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
