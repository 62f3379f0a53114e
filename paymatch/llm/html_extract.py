"""HTML extraction (operator 10): elements and texts that share an occurrence vector across a host's pages form its template, whose slots are read."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paymatch.plans.runtime import stage

#: Fixed values of HTML: elements whose content is not markup, elements that end a block, elements without content.
RAW = ("script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math")
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 "
                  "h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th "
                  "thead tr ul video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements, and words of class, id or role, that hold no article text wherever they stand.
ASIDE = frozenset("nav header footer aside form head button select dialog menu".split())
ASIDE_WORDS = frozenset("ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments complementary consent contentinfo "
                        "cookie cookies discussion disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices popup promo "
                        "related reply replies respond search share sharing sidebar social sponsor sponsored subscribe widget".split())
#: Elements of the article on a page whose host shows no template.
MAIN = frozenset("article main".split())
#: Elements without a place of their own in the tree, those whose start ends an open paragraph, and the other implied ends of HTML:
#: for a start tag the open elements it ends and those that bound the search.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u "
                   "var".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main "
                   "menu nav ol p pre search section table ul".split())
_ROWS, _LISTS = frozenset("tr td th".split()), frozenset("ul ol menu dir".split())
_GROUPS, _TABLE = _ROWS | frozenset("thead tbody tfoot caption".split()), frozenset(["table"])
IMPLIED = ({"li": (frozenset(["li"]), _LISTS), "tr": (_ROWS, _TABLE), "option": (frozenset(["option"]), frozenset(["select"]))}
           | {k: (frozenset(["dt", "dd"]), frozenset(["dl"])) for k in ("dt", "dd")}
           | {k: (frozenset(["td", "th"]), frozenset(["tr", "table"])) for k in ("td", "th")}
           | {k: (_GROUPS, _TABLE) for k in ("thead", "tbody", "tfoot")})
SCOPE = frozenset("table td th caption".split())  # an end tag of anything else does not reach beyond these

LEAST, PROOF = 3, 8  # pages that show an element to be a template's; pages that show a text among varying ones to be
BROKEN = 0.1  # share of a class's pages that may differ from it
AGREE, SKETCH = 6, 8  # smallest hashes of two vectors of one class that agree, of how many
MOST = 0.8  # share of the varying text that a slot must hold to be the article's

_LEX = re.compile(r"""<!--.*?(?:-->|\Z)|<(?P<raw>%s)\b(?:[^<>"']|"[^"]*"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"""
                  r"""|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^<>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>|(?P<text>[^<]+|<)""" % "|".join(RAW), re.S | re.I)
_NAMING = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z0-9]+")
_DIGITS = re.compile(r"[0-9]+")
_HEADING = re.compile(r"(?:^|/)h1(?![^/ ])")


def lex(page: str) -> Iterator[tuple[str, str, str]]:
    """(token, element, text): tags as tokens with class, id and role, white space and other attributes left out.

    A text has the empty token; comments, declarations and raw elements are left out.
    """
    for m in _LEX.finditer(page):
        if m["text"] is not None:
            yield "", "", m["text"]
        elif m["name"]:
            name = m["name"].lower()
            if m["close"]:
                yield f"</{name}>", name, ""
            else:
                naming = "".join(f' {k.lower()}="{(a or b or c).strip().lower()}"' for k, a, b, c in sorted(_NAMING.findall(m["rest"]))) if m["rest"] else ""
                yield f"<{name}{naming}>", name, ""


def _words(token: str) -> set[str]:
    return {w for _, a, _, _ in _NAMING.findall(token) for w in _WORD.findall(a)} if "=" in token else set()


def is_aside(token: str, name: str) -> bool:
    return name in ASIDE or bool(_words(token) & ASIDE_WORDS)


def blocks(page: str, main: frozenset[str] | None) -> list[str]:
    """Texts of the blocks inside the elements that the tokens `main` open (None: of the whole page), without asides."""
    out, text = [], []
    inside, aside, depth = ("", 0), ("", 0), 0

    def close():
        block = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if block:
            out.append(block)

    for token, name, content in lex(page):
        if not token:
            if not aside[1] and (main is None or inside[1]):
                text.append(content)
            continue
        opened = token[1] != "/" and name not in VOID
        if aside[1]:  # only its own end, with elements of its name nested in it counted
            if name == aside[0]:
                aside = (name, aside[1] + (1 if opened else -1 if token[1] == "/" else 0))
            continue
        if name in BLOCK:
            close()
        if main is not None:
            if inside[1] and name == inside[0]:
                inside = (name, inside[1] + (1 if opened else -1 if token[1] == "/" else 0))
            elif not inside[1] and token in main:
                inside = (name, 1)
                continue
        if opened and name not in ("html", "body") and is_aside(token, name):
            aside = (name, 1)
    close()
    return out


def densest(page: str) -> frozenset[str] | None:
    """The opening tag whose elements hold most of the text outside asides and links, the innermost of several."""
    gain, open_, aside = Counter(), [], ("", 0)
    links = 0
    for token, name, content in lex(page):
        if not token:
            n = len(content.strip())
            if not aside[1]:
                for t in {t for t, _ in open_}:
                    gain[t] += -n if links else n
            continue
        if aside[1]:
            if name == aside[0] and name not in VOID:
                aside = (name, aside[1] + (-1 if token[1] == "/" else 1))
            continue
        if token[1] == "/":
            if name == "a":
                links = max(0, links - 1)
            at = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][1] == name), None)
            if at is not None:
                del open_[at:]
        elif name not in VOID:
            if name not in ("html", "body") and is_aside(token, name):
                aside = (name, 1)
            elif name == "a":
                links += 1
            elif name in ("div", "section", "td", "body", "table"):
                open_.append((token, name))
    if not gain or max(gain.values()) <= 0:
        return None
    most = max(gain.values())
    return frozenset([[t for t, g in gain.items() if g >= 0.8 * most][-1]])


def host(url: Column) -> Column:
    """The host of a url in lower case; empty without one."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def walk(page: str) -> Iterator[tuple[str, str, tuple, bool, str]]:
    """Events (event, role, place, linked, text) of a page in order: "open" and "end" of elements, "text" of blocks; asides are left out.

    Elements nest as HTML has it, with implied end tags; what is open at the end ends there.  The role of an element is the path of element
    names to it and its own tag, numbers in it alike.  The place is the numbers of the open elements, of which the last holds the text.
    """
    stack: list[tuple[str, str, int]] = []  # name, role, number
    hidden = None  # height of the stack below an open aside
    text, links, linked, number = [], 0, 0, 0

    def flush():
        nonlocal linked
        joined = " ".join(html.unescape("".join(text)).split())
        whole, part = sum(map(len, text)), linked
        text.clear()
        linked = 0
        if joined:
            yield "text", stack[-1][1] if stack else "", tuple(x[2] for x in stack), 2 * part > whole, joined

    def drop(to: int):
        """Ends the elements above a height; those in an aside make no events."""
        nonlocal hidden, links
        if hidden is not None:
            if to > hidden:
                del stack[to:]
                return
            del stack[hidden:]
            hidden, links = None, 0
            if to == len(stack):
                return
        links = 0
        yield from flush()
        while len(stack) > to:
            yield "end", stack[-1][1], tuple(x[2] for x in stack), False, ""
            stack.pop()

    def nearest(names, bounds) -> int | None:
        for at in range(len(stack) - 1, -1, -1):
            if stack[at][0] in names:
                return at
            if stack[at][0] in bounds:
                return None
        return None

    for token, name, content in lex(page):
        if not token:
            if hidden is None:
                text.append(content)
                linked += len(content) if links else 0
            continue
        if name in ("html", "head", "body"):
            continue
        if token[1] == "/":
            if name == "a":
                links = max(0, links - 1)
            at = nearest((name,), () if name in _GROUPS or name == "table" else SCOPE)
            if at is not None:
                yield from drop(at)
            elif name in BLOCK and hidden is None:
                yield from flush()
            continue
        if name in ENDS_P and (at := nearest(("p",), SCOPE)) is not None:
            yield from drop(at)
        if name in IMPLIED:
            ends, bounds = IMPLIED[name]
            while (at := nearest(ends, bounds)) is not None:
                yield from drop(at)
        if name in VOID:
            if name in BLOCK and hidden is None:
                yield from flush()
            continue
        aside = hidden is None and is_aside(token, name)
        if name in INLINE and not aside:
            links += name == "a" and hidden is None
            continue
        if hidden is None and name not in INLINE:
            yield from flush()
        number += 1
        role = "/".join([*(x[0] for x in stack), name + _DIGITS.sub("0", token[1 + len(name):-1])])
        if aside:
            hidden = len(stack)
        stack.append((name, role, number))
        if hidden is None:
            yield "open", role, tuple(x[2] for x in stack), False, ""
    yield from drop(0)
    yield from flush()


def _token(role: str, text: str | None = None) -> int:
    return xxhash.xxh3_64_intdigest(role if text is None else f"{role}\0{text}") - (1 << 63)


_PAGE = "host string, token bigint, holder bigint, name string, page bigint, n int"


def _counts(frames):
    """How often each element and each text stands on each page; a page is named by the hash of its text, so that copies are one."""
    schema = pa.schema([("host", pa.string()), ("token", pa.int64()), ("holder", pa.int64()), ("name", pa.string()), ("page", pa.int64()), ("n", pa.int32())])
    for frame in frames:
        rows = []
        for host_, page in zip(*(frame.column(i).to_pylist() for i in range(2))):
            roles, texts = Counter(), Counter()
            for event, role, _, _, text in walk(page):
                if event == "open":
                    roles[role] += 1
                elif event == "text":
                    texts[_token(role, text), _token(role)] += 1
            key = xxhash.xxh3_64_intdigest(page) - (1 << 63)
            rows += [(host_, _token(r), None, r, key, n) for r, n in roles.items()]
            rows += [(host_, t, h, None, key, n) for (t, h), n in texts.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.types[i]) for i in range(6)], schema=schema)


_KEPT = "tokens array<struct<token: bigint, name: string, cls: int, once: boolean>>"


def _classes(frames):
    """For each host its classes: elements and texts whose occurrence vectors agree but for single pages."""
    for frame in frames:
        out = []
        for tokens in frame.column(1).to_pylist():
            size = {t["token"]: t["total"] for t in tokens if t["holder"] is None}
            fixed = Counter()
            for t in tokens:
                if t["holder"] is not None:
                    fixed[t["holder"]] += t["total"]
            heads: list[tuple[np.ndarray, int, int]] = []
            kept = []
            for t in sorted(tokens, key=lambda t: (-t["pages"], t["token"])):
                # A text on few pages is a template's only where the element holds nothing else.
                if t["holder"] is not None and t["pages"] < PROOF and fixed[t["holder"]] < (1 - BROKEN) * size.get(t["holder"], 0):
                    continue
                sketch = np.array(t["sketch"])
                cls = next((i for i, (other, pages, total) in enumerate(heads) if (other == sketch).sum() >= AGREE and t["pages"] >= (1 - BROKEN) * pages
                            and abs(t["total"] - total) <= BROKEN * total), None)
                if cls is None:
                    cls = len(heads)
                    heads.append((sketch, t["pages"], t["total"]))
                kept.append({"token": t["token"], "name": t["name"], "cls": cls, "once": t["once"] >= (1 - BROKEN) * t["pages"]})
            out.append(kept)
        yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(out, pa.list_(pa.struct([("token", pa.int64()), ("name", pa.string()), ("cls", pa.int32()), ("once", pa.bool_())])))],
                                         names=["host", "tokens"])


def equivalence_classes(pages: DataFrame, support: float = 0.5) -> DataFrame:
    """Staged rows (host, tokens): the elements on `LEAST` different pages of a host at least, and the texts on at least `support` of the
    pages that have the element around them, with the number of their class.

    Vectors over all pages are compared by the smallest of `SKETCH` hashes of (page, count), so that single pages do not part a class.
    """
    counts = pages.select("host", "html").mapInArrow(_counts, _PAGE)
    once = counts.groupBy("host", "token", "page").agg(F.max("holder").alias("holder"), F.max("name").alias("name"), F.max("n").alias("n"))
    tags = stage(once.groupBy("host", "token").agg(
        F.max("holder").alias("holder"), F.max("name").alias("name"), F.count("*").alias("pages"), F.sum("n").alias("total"), F.count(F.when(F.col("n") == 1, 1)).alias("once"),
        F.array(*(F.min(F.xxhash64("page", "n", F.lit(i))) for i in range(SKETCH))).alias("sketch")).where(F.col("pages") >= LEAST))
    around = tags.where("holder is null").select("host", F.col("token").alias("holder"), F.col("pages").alias("around"))
    texts = tags.where("holder is not null").join(around, ["host", "holder"]).where(F.col("pages") >= F.lit(support) * F.col("around")).drop("around")
    tags = tags.where("holder is null").unionByName(texts)
    return stage(tags.groupBy("host").agg(F.collect_list(F.struct("token", "holder", "name", "pages", "total", "once", "sketch")).alias("tokens"))
                 .mapInArrow(_classes, f"host string, {_KEPT}"))


def _measures(frames):
    """For each host sums over its pages: of elements that stand once the pages, the varying text in them and on the page, and pages with a
    varying main heading in them; of two elements of one class the pages on which the first comes before the second."""
    sums: dict[tuple, np.ndarray] = {}

    def out():
        rows = [(*k, *map(int, v)) for k, v in sums.items()]
        sums.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(1, 7))],
                                          names=["host", "a", "b", "pages", "inside", "whole", "heads"])

    for frame in frames:
        for host_, page, tokens in zip(*(frame.column(i).to_pylist() for i in range(3))):
            texts = {t["token"] for t in tokens if t["name"] is None}
            of = {t["name"]: (t["token"], t["cls"]) for t in tokens if t["name"] is not None and t["once"]}
            at: dict[str, list[int]] = {}
            held, heads, whole = Counter(), set(), 0
            for event, role, place, linked, text in walk(page):
                if event == "open":
                    at.setdefault(role, []).append(place[-1])
                elif event == "text" and not linked and _token(role, text) not in texts:
                    whole += len(text)
                    for number in place:
                        held[number] += len(text)
                    if _HEADING.search(role):
                        heads.update(place)
            found = [(*of[role], numbers[0]) for role, numbers in at.items() if role in of and len(numbers) == 1]
            for token, _, number in found:
                key = (host_, token, token)
                sums[key] = sums.get(key, 0) + np.array([1, held[number], whole, number in heads], np.int64)
            held_ = [f for f in found if held[f[2]]]
            for i, (x, cls, _) in enumerate(held_):
                for y, other, _ in held_[i + 1:]:
                    if cls == other:
                        sums[host_, x, y] = sums.get((host_, x, y), 0) + np.array([1, 0, 0, 0], np.int64)
        if len(sums) > 50_000:
            yield out()
    yield out()


def _slots(frames):
    """For each host the elements of valid classes that hold the article: (name, whether its heading is in it); and its constant texts."""
    for frame in frames:
        slots, constant = [], []
        for tokens, sums in zip(*(frame.column(i).to_pylist() for i in (1, 2))):
            own = {s["a"]: s for s in sums or () if s["a"] == s["b"]}
            before = {(s["a"], s["b"]): s["pages"] for s in sums or () if s["a"] != s["b"]}
            clash: dict[int, set[int]] = {}
            for (x, y), n in before.items():
                back = before.get((y, x), 0)
                if min(n, back) > BROKEN * (n + back):
                    clash.setdefault(x, set()).add(y)
                    clash.setdefault(y, set()).add(x)
            # Elements that keep no order with others leave their class until it is valid.
            while any(clash.values()):
                worst = max(clash, key=lambda x: (len(clash[x]), -own[x]["inside"], x))
                for y in clash.pop(worst):
                    clash[y].discard(worst)
                own.pop(worst)
            slots.append([{"name": t["name"], "head": 2 * own[t["token"]]["heads"] >= own[t["token"]]["pages"]} for t in tokens if t["name"] is not None and t["token"] in own
                          and own[t["token"]]["inside"] and own[t["token"]]["inside"] >= MOST * own[t["token"]]["whole"]])
            constant.append([t["token"] for t in tokens if t["name"] is None])
        yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(slots, pa.list_(pa.struct([("name", pa.string()), ("head", pa.bool_())]))), pa.array(constant, pa.list_(pa.int64()))],
                                         names=["host", "slots", "constant"])


def templates(pages: DataFrame, support: float = 0.5) -> DataFrame:
    """Staged rows (host, slots, constant): the elements that hold most varying text of the pages that have them, and the constant texts."""
    classes = equivalence_classes(pages, support)
    sums = (pages.select("host", "html").join(classes, "host").select("host", "html", "tokens")
            .mapInArrow(_measures, "host string, a bigint, b bigint, pages bigint, inside bigint, whole bigint, heads bigint")
            .groupBy("host", "a", "b").agg(*(F.sum(c).alias(c) for c in ("pages", "inside", "whole", "heads")))
            .groupBy("host").agg(F.collect_list(F.struct("a", "b", "pages", "inside", "whole", "heads")).alias("sums")))
    return stage(classes.join(sums, "host", "left").mapInArrow(_slots, "host string, slots array<struct<name: string, head: boolean>>, constant array<bigint>"))


def slot_text(page: str, slots: dict[str, bool], constant: set[int]) -> list[str] | None:
    """Blocks of the page's article slot: the innermost of its host's, or the nearest around it that has the heading; None without one."""
    at, texts = {}, []
    for event, role, place, _, text in walk(page):
        if event == "open" and role in slots:
            at.setdefault(role, []).append(place)
        elif event == "text":
            texts.append((place, text, _token(role, text) in constant))
    found = sorted(((places[0], slots[role]) for role, places in at.items() if len(places) == 1), key=lambda x: -len(x[0]))
    if not found:
        return None
    best, head = found[0]
    if not head:
        best = next((place for place, has in found if has and place == best[:len(place)]), best)
    inside = [(text, fixed) for place, text, fixed in texts if place[:len(best)] == best]
    return [text for text, fixed in inside if not fixed] or [text for text, _ in inside]


def article(page: str, slots: dict[str, bool], constant: set[int]) -> tuple[list[str], str]:
    """The article's blocks and where they come from: template, own (the page's own article or main), density or none."""
    if slots and (found := slot_text(page, slots, constant)) is not None:
        return found, "template"
    own = {t for t, n, _ in lex(page) if t and t[1] != "/" and n in MAIN and not is_aside(t, n)}
    if own:
        return blocks(page, frozenset(own)), "own"
    found = blocks(page, densest(page))
    return found, "density" if found else "none"


def _extract(frames):
    for frame in frames:
        texts = ["\n".join(article(page, {s["name"]: s["head"] for s in slots or ()}, set(constant or ()))[0])
                 for page, slots, constant in zip(*(frame.column(i).to_pylist() for i in (2, 3, 4)))]
        yield pa.RecordBatch.from_arrays([frame.column(0), frame.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                                         names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, support: float = 0.5) -> DataFrame:
    """Rows (page_id, url, text, n_chars), one for each row of `pages` (page_id, url, html).

    The text holds the article's blocks in page order, one a line, references decoded and white space made single spaces.  A
    null page is empty and has the empty text; pages without a url share one nameless host; copies of a page count as one page of the template;
    an empty table gives no rows; other columns are ignored.  Line breaks end a block.

    Elements (by place in the tree) and texts are counted per page, and those of a host whose occurrence vectors agree but for single pages
    form a class, so that each layout has its own; elements that keep no order with the rest leave it.  Texts on `support` of the pages that
    have the element around them are constant.  Of the elements that stand once, the innermost that holds `MOST` of the varying text is the
    article's slot, or the nearest around it with the varying main heading; it is read without constant texts and without the menus, forms
    and other asides nested in it.  Pages of which the template has no element are read by their own article or main, or by density.
    """
    named = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host(F.col("url")).alias("host"))
    kind = pages.schema["page_id"].dataType.simpleString()
    return (named.join(templates(named, support), "host", "left").select("page_id", "url", "html", "slots", "constant")
            .mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars bigint"))
