"""Main text of web pages, by wrappers inferred from the pages of a host."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

#: Fixed names. Elements without content of their own, elements inside a line, and elements whose end may be left out.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym area b bdi bdo big br cite code data del dfn em embed font i img input ins kbd label mark param q s samp small source span strike strong sub sup time track tt u var wbr".split())
OPTIONAL_END = set("p li dt dd tr td th option thead tbody tfoot".split())
#: Elements that are never part of an article's text, those whose content isn't markup, and those that hold articles.
DROPPED = set("nav footer aside form script style noscript template iframe object svg math canvas select button textarea title dialog menu audio video".split())
RAW = ("script", "style", "textarea", "title", "iframe", "noscript", "template", "svg")
ARTICLE = {"main": 1, "article": 2}
#: Words that mark what surrounds an article, as a class, id or role of its own or at the end of one; those that also do at the beginning; those that do for reader comments; those that don't inside an article.
MARKS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup "
    "comment comments disqus reply replies respond sidebar aside menu nav navbar navigation breadcrumb breadcrumbs share sharing social related recommended recommendations footer header masthead "
    "toolbar pagination pager widget login search contentinfo complementary form dialog alert".split()
)
LEADING = set("ad ads advert adverts advertisement sponsored promo cookie cookies gdpr newsletter comment comments disqus related recommended share sharing social sidebar breadcrumb breadcrumbs footer nav navbar pagination".split())
COMMENTS = set("comment comments disqus reply replies respond".split())
#: Marks that are also names of what an article is about or built of: inside an article, and of a form around a page, they count only where they don't hold most of the text.
DOUBTFUL = MARKS - LEADING - COMMENTS
TITLES = {"header", "masthead"}
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
#: A slot in so large a share of a host's pages, and in so many, with one text throughout is part of the template.
TEMPLATE_SHARE, TEMPLATE_PAGES = 0.8, 5
#: Characters of a block from which it tells an article from others; shorter ones are dates, counters, titles and the like.
LONG_BLOCK = 40
#: Streams, and then wrappers, that are aligned in one task.
STREAMS, WRAPPERS = 2000, 16


class Block:
    """A block of text: whether it is in an element that holds no article, how deep in articles, what marks it, characters in links."""

    __slots__ = ("article", "hard", "linked", "mark", "text", "weak")

    def __init__(self, text, hard, article, mark, weak, linked):
        self.text, self.hard, self.article, self.mark, self.weak, self.linked = text, hard, article, mark, weak, linked


def marks_of(attributes: str, inside: bool) -> tuple[str | None, list[str]]:
    """(mark, weak marks): mark is c for reader comments and s for else; weak are names that only begin or end with a mark."""
    mark, weak = None, []
    for _, value in NAMES.findall(attributes):
        for name in value.strip("\"'").split():
            parts = [x.lower() for x in re.split(r"[-_:]+|(?<=[a-z])(?=[A-Z])", name) if x]
            found = {x for x in (parts[-1:] + [y for y in parts[:1] if y in LEADING]) if x in MARKS and not (inside and x in TITLES)}
            if found & COMMENTS:
                mark = "c"
            elif found and len(parts) == 1 and not (inside and found <= DOUBTFUL):
                mark = mark or "s"
            elif found:
                weak.append("-".join(parts))
    return mark, weak


def read_page(html: str) -> tuple[list[str], list[Block]]:
    """(tokens, blocks): the page's stream of tags, with a token that begins with # for each block of text and says where it stands."""
    import html as entities

    tokens: list[str] = []
    blocks: list[Block] = []
    stack: list[tuple] = []  # name, hard, article, mark, weak marks
    parts: list[str] = []
    linked, in_link = 0, False

    def state():
        return stack[-1][1:] if stack else (False, 0, None, ())

    def flush():
        nonlocal linked, in_link
        text = " ".join("".join(parts).split())
        if text:
            hard, article, mark, weak = state()
            tokens.append("#" + "x" * hard + str(article) + (mark or "") + "".join("." + x for x in weak))
            blocks.append(Block(text, hard, article, mark, weak, linked))
            in_link = False  # a link holds a block at most
        parts.clear()
        linked = 0

    def text_until(end):
        nonlocal linked
        if end > at:
            raw = entities.unescape(html[at:end])
            parts.append(raw)
            if in_link:
                linked += len(raw.strip())

    def pop(name):
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == name:
                del stack[i:]
                return

    at = 0
    while (m := TAG.search(html, at)) is not None:
        text_until(m.start())
        at = m.end()
        if m[2] is None:
            continue
        closing, name, attributes = bool(m[1]), m[2].lower(), m[3]
        hard, article, mark, weak = state()
        own_mark, own_weak = marks_of(attributes, bool(article)) if attributes and not closing else (None, [])
        hidden = bool(attributes and not closing and HIDDEN.search(attributes))
        if name == "a":
            in_link = not closing and re.search(r"\bhref\b", attributes, re.I) is not None
        if name in VOID and name in INLINE:
            if name == "br":
                parts.append(" ")
            continue
        if name in INLINE and not (own_mark or own_weak or hidden or closing and any(x[0] == name for x in stack)):
            continue
        flush()
        if name in RAW and not closing:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if closing:
            pop(name)
            if name not in OPTIONAL_END:
                tokens.append("/" + name)
            continue
        if stack and stack[-1][0] == "p" and name not in INLINE:
            stack.pop()
        if name in OPTIONAL_END and name != "p":
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ("ul", "ol", "dl", "table", "select"):
                    break
                if stack[i][0] == name:
                    del stack[i:]
                    break
        tokens.append(".".join([name, *sorted(own_weak), *([own_mark] if own_mark else [])]))
        if name in VOID or attributes.endswith("/") and name not in ARTICLE and name not in ("p", "div"):
            continue
        hard, article, mark, weak = state()
        hard = hard or hidden or name in DROPPED and name != "form" or name == "header" and not article
        if name == "form":
            own_weak = [*own_weak, "form"]
        if name in ARTICLE:
            # what holds an article is no advert; a marked article counts if there is no other
            article = max(article, ARTICLE[name])
            mark, weak = mark if mark == "c" else "v" if own_mark else None, ()
        elif name not in ("body", "html"):
            mark, weak = "c" if "c" in (mark, own_mark) else mark or own_mark, tuple(dict.fromkeys((*weak, *own_weak)))
        stack.append((name, hard, article, mark, weak))
    text_until(len(html))
    flush()
    return tokens, blocks


def _repeats(keys: list):
    """Distances at which a run of keys may repeat next to itself, small ones first: those between neighbouring equal keys.

    A group that has no key but once at most in each turn is found at every length.
    """
    import numpy as np

    number: dict = {}
    x = np.fromiter((number.setdefault(k, len(number)) for k in keys), "int64", len(keys))
    order = np.argsort(x, kind="stable")
    gap = np.diff(order)[x[order][1:] == x[order][:-1]]
    for period in np.unique(gap).tolist():
        same = np.append(np.append(False, x[period:] == x[:-period]), False)
        if np.diff(np.nonzero(~same)[0]).max(initial=1) > period:
            yield period


def fold(tokens: list[str]) -> list[tuple]:
    """Items (key, slots): groups that repeat next to each other become one group, whose key is the tuple of its parts'; slots list the blocks of each text of the key."""
    items, n = [], 0
    for t in tokens:
        items.append((t, [[n]] if t[0] == "#" else []))
        n += t[0] == "#"
    return folded(items, lambda turns: [s for own in zip(*turns) for s in zip(*(x[1] for x in own))], lambda key, slots: (key, [[b for x in s for b in x] for s in slots]))


def folded(items: list, joined, made, good=lambda turns: True) -> list:
    """Items with neighbouring repeats as groups: joined(turns) gives the slots of the turns side by side, made(key, slots) the item; only good turns become one."""
    changed = True
    while changed:
        changed = False
        for period in _repeats([x[0] for x in items]):
            keys = [x[0] for x in items]
            out, i = [], 0
            while i < len(items):
                group = keys[i : i + period]
                j = i + period
                while len(group) == period and keys[j : j + period] == group:
                    j += period
                if j - i < 2 * period or isinstance(group[0], str) and group[0][0] == "#":  # groups begin with a tag
                    out.append(items[i])
                    i += 1
                    continue
                turns = [items[k : k + period] for k in range(i, j, period)]
                if not good(turns):
                    out.append(items[i])
                    i += 1
                    continue
                key = group[0] if period == 1 and isinstance(group[0], tuple) else tuple(group)
                out.append(made(key, joined(turns)))
                changed = True
                i = j
            if changed:
                items = out
                break
    return items


def slots_in(key) -> int:
    return sum(map(slots_in, key)) if isinstance(key, tuple) else int(key[0] == "#")


def absorb(items: list, groups: list[tuple], merge, optional=lambda x: False) -> list:
    """Single instances of known repeated groups, without optional parts, become such groups; merge(run of items) gives what they carry."""
    for group in groups:
        out, i = [], 0
        while i < len(items):
            run = items[i : i + len(group)]
            if tuple(x[0] for x in run) == group and not (len(run) > 1 and any(map(optional, run))):
                out.append((group, *merge(run)))
                i += len(group)
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def groups_of(keys) -> list[tuple]:
    """The repeated groups among keys and inside them, inner ones first."""
    found: dict = {}

    def walk(key):
        if isinstance(key, tuple):
            for k in key:
                walk(k)
            found.setdefault(key)

    for k in keys:
        walk(k)
    return list(found)


def as_key(x):
    return tuple(map(as_key, x)) if isinstance(x, list) else x


def _merge_page(run):
    return ([s for x in run for s in x[1]],)


def _merge_wrapper(run):
    return any(x[1] for x in run), [s for x in run for s in x[2]]


def _joined(a, b):
    return [min(a[0], b[0]), max(a[1], b[1]), a[2] + b[2], a[3] + b[3], a[4] + b[4]]


def _turns(a, b):
    """As _joined, for turns of a group in the same pages."""
    return [*_joined(a, b)[:4], max(a[4], b[4])]


def align(a: list, b: list) -> list:
    """One wrapper for what two match: items (key, optional, slots).

    Equal tags stay; texts become a slot. A mismatch is first tried as a repeat: a group
    that one side repeats takes in its single instances on the other, and what stands
    next to its like after the merge becomes a group. What then only one side has is
    optional, in the order of the streams and without unions.
    """
    from difflib import SequenceMatcher
    from functools import reduce

    groups = groups_of(dict.fromkeys([x[0] for x in (*a, *b)]))
    a, b = (absorb(x, groups, _merge_wrapper, lambda y: y[1]) for x in (a, b))
    out: list = []
    for op, i, j, k, m in SequenceMatcher(None, [x[0] for x in a], [x[0] for x in b], autojunk=False).get_opcodes():
        if op == "equal":
            out += [(x[0], x[1] or y[1], [_joined(s, t) for s, t in zip(x[2], y[2])]) for x, y in zip(a[i:j], b[k:m])]
        else:
            out += [(x[0], True, x[2]) for x in (*a[i:j], *b[k:m])]
    # a turn of which a part may lack is no turn
    whole = lambda turns: len(turns[0]) == 1 or not any(x[1] for turn in turns for x in turn)
    return folded(out, lambda turns: (all(x[1] for turn in turns for x in turn), [reduce(_turns, s) for own in zip(*turns) for s in zip(*(x[2] for x in own))]), lambda key, found: (key, *found), whole)


def host_of(url: Column) -> Column:
    """The host in lower case; the empty string if the url is null or has none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def linky(chars: int, linked: int) -> bool:
    return 2 * linked > chars


def exempt_marks(parts) -> set[str]:
    """Weak marks of most of the text of parts (hard, mark, weak, chars, linked, times): what holds most of a page isn't beside its article. A form must hold blocks as long as an article's."""
    total, of, long = 0, {}, {}
    for hard, mark, weak, chars, linked, times in parts:
        if not hard and not mark and not linky(chars, linked):
            total += chars
            for w in weak:
                of[w] = of.get(w, 0) + chars
                long[w] = long.get(w, 0) + chars * (chars >= LONG_BLOCK * times)
    return {w for w, n in of.items() if 2 * n > total and (w != "form" or 2 * long[w] > n)}


def main_blocks(blocks: list[Block], exempt: set[str] | None = None, links: dict | None = None, fixed=()) -> list[int]:
    """Places of the blocks that may be main text: unmarked ones in an article, if there are any, else those that aren't mostly links.

    exempt, links and fixed are what the host's wrapper tells: weak marks that don't
    count, blocks that are or aren't mostly links there, and blocks of its template.
    """
    if exempt is None:
        exempt = exempt_marks((b.hard, b.mark, b.weak, len(b.text), b.linked, 1) for b in blocks)
    free = [i for i, b in enumerate(blocks) if not b.hard and exempt.issuperset(b.weak) and i not in fixed]
    own = [i for i in free if not blocks[i].mark]
    size = [sum(len(blocks[i].text) for i in own if blocks[i].article >= level) for level in (0, 1, 2)]
    if size[1]:
        level = 2 if 2 * size[2] >= size[1] else 1
        return [i for i in own if blocks[i].article >= level]
    links = links or {}
    keep = [i for i in own if not links.get(i, linky(len(blocks[i].text), blocks[i].linked))]
    return keep or [i for i in free if blocks[i].mark == "v"]


def copy_key(html: str, blocks: list[Block]) -> str:
    """Equal for near copies: what the page's long blocks of main text say, if they are most of it, else all its main text; the html if it has none."""
    texts = [blocks[i].text for i in main_blocks(blocks)]
    long = [t for t in texts if len(t) >= LONG_BLOCK]
    if 2 * sum(map(len, long)) > sum(map(len, texts)):
        texts = long
    return "\x1f".join(sorted(set(texts))) or html


def _profiles(batches):
    """For each page its folded stream of tags, and for each slot the least and greatest hash of its texts, characters and linked ones, and 1."""
    import json

    import pandas as pd
    import xxhash

    for pdf in batches:
        rows = []
        for host, html in zip(pdf["host"], pdf["html"]):
            html = html or ""
            tokens, blocks = read_page(html)
            items = fold(tokens)
            slots = []
            for _, own in items:
                for s in own:
                    hashes = [xxhash.xxh3_64_intdigest(blocks[b].text.encode("utf-8", "surrogatepass")) >> 1 for b in s]
                    slots += [min(hashes), max(hashes), sum(len(blocks[b].text) for b in s), sum(blocks[b].linked for b in s), 1]
            rows.append((host, xxhash.xxh3_128_digest(copy_key(html, blocks).encode("utf-8", "surrogatepass")), xxhash.xxh3_128_digest(html.encode("utf-8", "surrogatepass")), json.dumps([k for k, _ in items]), slots))
        yield pd.DataFrame(rows, columns=["host", "page", "digest", "stream", "slots"])


def _merge_streams(batches):
    """Pages of one host and stream become one row a batch."""
    import pandas as pd

    for pdf in batches:
        seen: dict = {}
        for host, stream, flat in zip(pdf["host"], pdf["stream"], pdf["slots"]):
            slots = [[int(v) for v in flat[i : i + 5]] for i in range(0, len(flat), 5)]
            n, old = seen.get((host, stream), (0, None))
            seen[host, stream] = n + 1, slots if old is None else [_joined(x, y) for x, y in zip(old, slots)]
        yield pd.DataFrame([(h, k, n, [v for s in slots for v in s]) for (h, k), (n, slots) in seen.items()], columns=["host", "stream", "pages", "slots"])


def merged(wrappers: list) -> list:
    """One wrapper of many, aligned in pairs, so that each is in few alignments."""
    while len(wrappers) > 1:
        wrappers = [align(*wrappers[i : i + 2]) if i + 1 < len(wrappers) else wrappers[i] for i in range(0, len(wrappers), 2)]
    return wrappers[0]


def _infer_streams(key, pdf):
    import json

    import pandas as pd

    known: dict = {}
    for stream, flat in zip(pdf["stream"], pdf["slots"]):
        slots = [list(map(int, flat[i : i + 5])) for i in range(0, len(flat), 5)]
        old = known.get(stream)
        known[stream] = [_joined(x, y) for x, y in zip(old, slots)] if old is not None else slots
    wrappers = []
    for stream in sorted(known):
        at, items = 0, []
        for k in map(as_key, json.loads(stream)):
            n = slots_in(k)
            items.append((k, False, known[stream][at : at + n]))
            at += n
        wrappers.append(items)
    return pd.DataFrame([{"host": key[0], "part": int(key[1]), "wrapper": json.dumps(merged(wrappers)), "pages": int(pdf["pages"].sum())}])


def read_wrapper(text: str) -> list:
    import json

    return [(as_key(k), optional, slots) for k, optional, slots in json.loads(text)]


def _infer_wrappers(key, pdf):
    import json

    import pandas as pd

    return pd.DataFrame([{"host": key[0], "part": int(key[1]), "wrapper": json.dumps(merged([read_wrapper(w) for w in sorted(pdf["wrapper"])])), "pages": int(pdf["pages"].sum())}])


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, wrapper, pages: a union-free expression of tags, optional and repeated groups and slots for each host.

    Pages are reduced to folded streams of tags where they are read, near copies of a page (see copy_key) to
    one, lest they pass for a template, and equal streams to a row; streams are aligned within groups of a host, then the groups' wrappers, so
    a host with a third of all pages is no task's whole.
    """
    each = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).mapInPandas(_profiles, "host string, page binary, digest binary, stream string, slots array<long>")
    # of near copies the one of the least digest, so that reruns agree
    each = each.groupBy("host", "page").agg(F.min(F.struct("digest", "stream", "slots")).alias("x")).select("host", "x.stream", "x.slots")
    streams = materialize(each.mapInPandas(_merge_streams, "host string, stream string, pages long, slots array<long>"), "streams")
    n, columns = max(WRAPPERS, -(-streams.count() // STREAMS)), "host string, part int, wrapper string, pages long"
    parts = materialize(streams.groupBy("host", F.pmod(F.xxhash64("stream"), F.lit(n)).cast("int").alias("part")).applyInPandas(_infer_streams, columns), "wrappers")
    while n > 1:
        n = -(-n // WRAPPERS)
        parts = materialize(parts.groupBy("host", F.pmod(F.col("part"), F.lit(n)).alias("part")).applyInPandas(_infer_wrappers, columns), "wrappers")
    return parts.select("host", "wrapper", "pages")


def context_of(token: str) -> tuple[bool, str | None, tuple]:
    """(hard, mark, weak marks) that a text's token tells."""
    own, *weak = token[1:].split(".")
    return own[0] == "x", own[-1] if own[-1].isalpha() and own[-1] != "x" else None, tuple(weak)


def texts_of(key) -> list[str]:
    """The tokens of the texts in a key."""
    return [t for k in key for t in texts_of(k)] if isinstance(key, tuple) else [key] * (key[0] == "#")


def host_exempt(wrapper: list) -> set[str]:
    """Weak marks that hold most of the text of a host's pages."""
    return exempt_marks((*context_of(t), s[2], s[3], s[4]) for key, _, slots in wrapper for t, s in zip(texts_of(key), slots))


def slot_notes(items: list, wrapper: list, pages: int) -> tuple[list, dict]:
    """(fixed, links) of a page's items: what their slots list, where the host's pages have one text throughout, if others differ; and whether a slot is mostly links on the host."""
    from difflib import SequenceMatcher

    items = absorb(items, groups_of(dict.fromkeys(x[0] for x in wrapper)), _merge_page)
    varies = any(s[0] != s[1] for _, _, slots in wrapper for s in slots)
    fixed, links = [], {}
    for i, j, n in SequenceMatcher(None, [x[0] for x in items], [x[0] for x in wrapper], autojunk=False).get_matching_blocks():
        for (_, own), (_, _, slots) in zip(items[i : i + n], wrapper[j : j + n]):
            for found, s in zip(own, slots):
                links.update(dict.fromkeys(found, linky(s[2], s[3])))
                if varies and s[0] == s[1] and s[4] >= max(TEMPLATE_PAGES, TEMPLATE_SHARE * pages):
                    fixed += found
    return fixed, links


def main_text(html: str, wrapper: list | None = None, pages: int = 0, known: dict | None = None) -> str:
    """The text of the page's main blocks. Where its host has TEMPLATE_PAGES pages, the wrapper tells what is template, links or a mark that counts; else the page alone does.

    known: what streams that were matched with this wrapper before have told.
    """
    tokens, blocks = read_page(html)
    if not wrapper or pages < TEMPLATE_PAGES:
        return " ".join(blocks[i].text for i in main_blocks(blocks))
    items, known = fold(tokens), {} if known is None else known
    stream = tuple(k for k, _ in items)
    if stream not in known:
        known[stream] = slot_notes([(k, [[(i, s)] for s in range(len(own))]) for i, (k, own) in enumerate(items)], wrapper, pages)
    if None not in known:
        known[None] = host_exempt(wrapper)
    fixed, links = known[stream]
    return " ".join(blocks[i].text for i in main_blocks(blocks, known[None], {b: x for (i, s), x in links.items() for b in items[i][1][s]}, {b for i, s in fixed for b in items[i][1][s]}))


def _extract(batches):
    import pyarrow as pa

    wrappers: dict = {}
    for batch in batches:
        col = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
        texts = []
        for html, host, wrapper, pages in zip(*[col[c].to_pylist() for c in ("_html", "_host", "_wrapper", "_pages")]):
            if host not in wrappers:
                if len(wrappers) > 1000:
                    wrappers.clear()
                wrappers[host] = read_wrapper(wrapper) if wrapper else None, {}
            own, known = wrappers[host]
            if len(known) > 1000:
                known.clear()
            texts.append(main_text(html or "", own, pages or 0, known))
        keep = [c for c in col if c not in ("_html", "_host", "_wrapper", "_pages")]
        yield pa.RecordBatch.from_arrays([*[col[c] for c in keep], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages' columns but the html, and text and n_chars of the article.

    A host's wrapper tells which slots of its template have one text throughout; they are
    left out, as are menus, headers, footers, asides, forms, scripts, comments and what
    class names mark as adverts, notices and the like. If the page has an article or main
    element, only blocks in it count; else those that aren't mostly links.

    Null and empty html give an empty text. Pages without a host share the wrapper of the
    empty host. Repeated pages are pages of their own; an empty table gives an empty
    result. Columns named text and n_chars are replaced; names that start with _ are
    reserved. Spark broadcasts the wrappers while their table is small, else joins by host.
    """
    small_batches(pages.sparkSession)
    wrappers = infer_wrappers(pages, url_col, html_col).withColumnsRenamed({"host": "_w_host", "wrapper": "_wrapper", "pages": "_pages"})
    keep = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    given = pages.select(*keep, F.col(html_col).alias("_html"), host_of(F.col(url_col)).alias("_host"))
    joined = given.join(wrappers, given["_host"] == wrappers["_w_host"], "left").drop("_w_host")
    return joined.mapInArrow(_extract, pages.select(*keep).schema.add("text", "string").add("n_chars", "long"))


def op7_html_extract(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
