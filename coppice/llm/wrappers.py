"""Main text of pages by wrappers: union-free regular expressions inferred per host.

A page is read as a stream of block tags and texts; inline tags vanish, implied ends are put in, scripts, styles and
comments are gone. A stream is folded: units that repeat side by side become repeated groups, again and again, so that
pages of one template have nearly the same skeleton. The skeletons of a host are aligned one after another with the
wrapper so far: what only one side has becomes optional, repeated groups are aligned inside, and texts are slots. The
result is a union-free expression over tags; a host of several templates has several. A page is matched with its
host's wrappers, which says what slot each of its texts fills, and the texts in slots of main text are joined.

A slot is main text by what the wrapper has around it: elements that name themselves (article, main, nav, classes such
as comments) decide where there are any. In wrappers without a named main part the pages decide: a text that fills the
same slot on many pages of the template is the template's own, and lists and boxes of links are menus; what varies is
content. Pages that hold nearly nothing else but such texts are copies of each other, and keep them. A page that no
wrapper of its host covers is its own wrapper.

Skeletons are counted with map-side combine and aligned in groups of at most GROUP; the groups' wrappers are aligned
again until a host has one group, or they do not get fewer. The WRAPPERS that cover most pages then stand for a host.
Wrappers meet pages in a left join on the host; hosts with over a thousandth of all pages, of which there are fewer
than a thousand, are salted.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coppice.llm.common import appended, written

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big button cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var "
    "math mrow mi mn mo ms mtext mfrac msqrt mroot msup msub msubsup mover munder munderover mfenced mstyle semantics".split()
)
RAW = "script style".split()  # to their end tag, or to the end of the page
CLOSED = "textarea title iframe noscript template svg object canvas audio video select".split()  # to their end tag, if there is one
IN_HEAD = frozenset("title base basefont bgsound link meta style script noscript template noframes".split())
CLOSES = {  # an open element of these kinds ends where the key starts
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "body": {"head"},
}
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split()
)
BARRIER = {"li": {"ul", "ol"}, "p": {"td", "th", "li", "div", "section", "article", "body"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "dt": {"dl"}, "dd": {"dl"}}
# Words of names, classes and ids that tell what an element is for.
NEVER_TAG = frozenset("nav aside footer form menu dialog head option datalist".split()) | frozenset(CLOSED)
NEVER = frozenset(
    "ad ads adv advert advertisement advertising adsense banner breadcrumb breadcrumbs captcha comment comments commentlist consent cookie cookies "
    "disqus dropdown footer gdpr login menu modal nav navbar navigation newsletter notice pagination pager popup promo promoted recommended related "
    "reply replies share sharing sidebar signup social sponsor sponsored subscribe subscription teaser toolbar widget".split()
)
NEVER_OUTSIDE = frozenset("header masthead topbar copyright legal tags search skip".split())
MAIN = frozenset("article articlebody main story entry post".split())
# Words above that name content as well, and words that say nothing of what an element is for. Within
# main text the former tell only if all others are among the latter.
EITHER = frozenset("login menu notice recommended related reply replies social teaser toolbar widget promoted".split())
PLAIN = frozenset("area bar block box buttons button content container group inner item items left link links list outer panel posts right row section site small top wrap wrapper".split())
# Words that make even an article something else.
NO_ARTICLE = frozenset("ad ads advert advertisement comment comments promo promoted sponsored".split())

_SCAN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:" + "|".join(RAW) + r")\b[^>]*>.*?(?:</(?:" + "|".join(RAW) + r")\s*>|\Z)|<(" + "|".join(CLOSED) + r")\b[^>]*>(?:(?!<\1\b).)*?</\1\s*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/a-zA-Z][^>]*>|([^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
_PART = re.compile(r"[a-z]+")
TEXT = "#"
#: Skeletons aligned at once, wrappers of a host, tokens of a skeleton that is aligned (a longer one stands for itself).
GROUP, WRAPPERS, TOKENS = 64, 64, 4000
#: Share of a template's pages, and number of them, on which a text makes a slot's text the template's.
COMMON, COMMON_PAGES = 0.3, 3


def signature(name: str, attributes: str) -> str:
    """Name and the words of class, id, role and itemprop, so that numbered ids do not differ."""
    if "=" not in attributes:
        return name
    parts = sorted({w for _, v in _ATTRIBUTE.findall(attributes) for w in _PART.findall(v.lower())})
    return f"{name}.{'.'.join(parts)}" if parts else name


def parse(page: str | None) -> tuple[list[str], list[str], list[float]]:
    """The stream of a page (signatures, ``/name`` for ends, ``#`` for texts), its texts in order, and of each the
    share that lies in links."""
    stream: list[str] = []
    texts: list[str] = []
    linked: list[float] = []
    stack: list[str] = []
    run: list[str] = []
    in_links: list[int] = [0, 0]  # open a elements, characters in such

    def flush() -> None:
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            if text:
                stream.append(TEXT)
                texts.append(text)
                linked.append(min(1.0, in_links[1] / len(text)))
            run.clear()
        in_links[1] = 0

    def close(to: int) -> None:
        while len(stack) > to:
            stream.append("/" + stack.pop())

    for m in _SCAN.finditer(page or ""):
        text, name = m.group(5), m.group(3)
        if text is not None:
            if stack and stack[-1] == "head" and text.strip():
                flush()
                close(len(stack) - 1)
            run.append(text)
            if in_links[0]:
                in_links[1] += len(text)
            continue
        if name is None:
            continue
        name = name.lower()
        if name in INLINE:
            if name == "a":
                in_links[0] = 0 if m.group(2) else 1
            continue
        if name in VOID:
            if name in ("br", "hr"):
                run.append(" ")
            continue
        if m.group(2):
            if name in stack:
                flush()
                close(len(stack) - 1 - stack[::-1].index(name))
            continue
        flush()
        if "head" in stack and name not in IN_HEAD:
            close(stack.index("head"))
        closes = CLOSES.get(name, set()) | ({"p"} if name in ENDS_P else set())
        barrier = BARRIER.get(name, {"table", "td", "th"} if name in ENDS_P else set())
        for i in range(len(stack) - 1, -1, -1):
            if stack[i] in closes:
                close(i)
                break
            if stack[i] in barrier:
                break
        stack.append(name)
        stream.append(signature(name, m.group(4)))
    flush()
    close(0)
    return stream, texts, linked


# A wrapper is a list of nodes [what, optional]: what is a token or, for a repeated group, a list of nodes; optional is
# 0 for a node that always occurs, else the number of the optional group it is in.


def fold(stream: list[str], longest: int = 16) -> list:
    """The skeleton of a stream: units that repeat side by side become one repeated group, inner ones first."""
    seq: list = list(stream)
    changed = True
    while changed:
        changed = False
        for n in range(1, longest + 1):
            out: list = []
            i = 0
            while i < len(seq):
                unit = seq[i : i + n]
                group = ("+", tuple(unit))
                if len(unit) == n and _whole(unit) and (seq[i + n : i + 2 * n] == unit or (out and out[-1] == group) or seq[i + n : i + n + 1] == [group]):
                    j = i + n
                    while seq[j : j + n] == unit or seq[j : j + 1] == [group]:
                        j += 1 if seq[j : j + 1] == [group] else n
                    if out and out[-1] == group:
                        out.pop()
                    out.append(group)
                    i, changed = j, True
                else:
                    out.append(seq[i])
                    i += 1
            seq = out
    return _nodes(seq)


def _whole(unit: list) -> bool:
    """Starts with an element and ends every one it starts; a group alone is no unit of another."""
    depth = 0
    for x in unit:
        if isinstance(x, str) and x != TEXT:
            depth += -1 if x[0] == "/" else 1
            if depth < 0:
                return False
    return depth == 0 and isinstance(unit[0], str) and unit[0] != TEXT


def _nodes(seq: list | tuple) -> list:
    return [[_nodes(x[1]) if isinstance(x, tuple) else x, 0] for x in seq]


def _key(what: object) -> object:
    while isinstance(what, list):
        what = what[0][0]
    return what


def align(wrapper: list, other: list, number: list[int]) -> list:
    """The least general expression of this kind that covers both: by longest common subsequence of their nodes.

    A repeated group matches a group or a single unit that starts alike. number: the last optional group's.
    """
    a, b = wrapper, _grouped(other, wrapper)
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    ka, kb = [_key(x[0]) for x in a], [_key(x[0]) for x in b]
    same = lambda i, j: ka[i] == kb[j] and isinstance(a[i][0], list) == isinstance(b[j][0], list)
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if same(i, j) else max(best[i + 1][j], best[i][j + 1])
    out: list = []
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and same(i, j):
            (x, o), (y, p) = a[i], b[j]
            out.append([align(x, y, number) if isinstance(x, list) else x, o or p])
            i, j = i + 1, j + 1
            continue
        number[0] += 1
        while i < n and not (j < m and same(i, j)) and (j == m or best[i + 1][j] >= best[i][j + 1]):
            out.append([a[i][0], a[i][1] or number[0]])
            i += 1
        number[0] += 1
        while j < m and not (i < n and same(i, j)) and (i == n or best[i + 1][j] < best[i][j + 1]):
            out.append([b[j][0], b[j][1] or number[0]])
            j += 1
    return out


def _grouped(other: list, wrapper: list) -> list:
    """``other`` with a single unit made a group where the wrapper repeats units that start alike, and so nested."""
    keys = {_key(x[0]) for x in wrapper if isinstance(x[0], list)}
    plain = {x[0] for x in wrapper if not isinstance(x[0], list)}
    out, i = [], 0
    while i < len(other):
        what = other[i][0]
        if isinstance(what, str) and what in keys and what not in plain and what[0] != "/":
            depth, j = 0, i
            while j < len(other):
                t = other[j][0]
                if isinstance(t, str) and t != TEXT:
                    depth += -1 if t[0] == "/" else 1
                j += 1
                if depth == 0:
                    break
            if depth == 0:
                out.append([other[i:j], 0])
                i = j
                continue
        out.append(other[i])
        i += 1
    return out


def role(sig: str, inside: bool) -> str:
    """``never``, ``main`` or '' for an element, inside main text or not."""
    name, *parts = sig.split(".")
    words = set(parts)
    if name in NEVER_TAG:
        return "never"
    if name in ("article", "main") and not inside:
        return "never" if words & NO_ARTICLE else "main"
    if name not in ("html", "body", "main"):
        telling = words & NEVER
        if inside and telling and telling <= EITHER and not words - telling <= PLAIN:
            telling = set()
        if telling or (not inside and words & NEVER_OUTSIDE):
            return "never"
    if not inside and name == "header":
        return "never"
    return "main" if name in ("article", "main") or words & MAIN and name not in ("html", "body") else ""


NEUTRAL, KEEP, DROP = 0, 1, 2


def decisions(tokens: list[str]) -> list[int]:
    """Of each text of a stream (or slot of a wrapper): KEEP or DROP where elements around it tell, or NEUTRAL.

    Where one is told to be main text, all others go; else those not told against are NEUTRAL.
    """
    slots: list[tuple[bool, bool]] = []
    stack: list[tuple[str, bool, bool]] = []
    for what in tokens:
        never, main = stack[-1][1:] if stack else (False, False)
        if what == TEXT:
            slots.append((never, main))
        elif what[0] == "/":
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == what[1:]), None)
            if at is not None:
                del stack[at:]
        else:
            kind = role(what, main)
            stack.append((what.split(".")[0], never or kind == "never", main or kind == "main"))
    some = any(main and not never for never, main in slots)
    return [DROP if never or (some and not main) else KEEP if main else NEUTRAL for never, main in slots]


class Expression:
    """A wrapper compiled: which characters stand for which tokens, and what is known of its slots."""

    def __init__(self, wrapper: list):
        import regex

        self.wrapper = wrapper
        tokens = unrolled(wrapper)
        self.letters = {TEXT: "#"}
        for t in tokens:
            self.letters.setdefault(t, chr(0x4E00 + len(self.letters)))
        self.known = decisions(tokens)
        self.neutral = NEUTRAL in self.known and KEEP not in self.known
        self.slots = iter(range(len(self.known)))
        self.pattern = regex.compile(self._regex(wrapper))
        self.program: list[tuple] | None = None

    def _regex(self, nodes: list) -> str:
        out, i = [], 0
        while i < len(nodes):
            group, part = nodes[i][1], []
            while i < len(nodes) and nodes[i][1] == group:
                what = nodes[i][0]
                if isinstance(what, list):
                    part.append(f"(?:{self._regex(what)})+")
                elif what == TEXT:
                    part.append(f"(?P<s{next(self.slots)}>#)")
                else:
                    part.append(self.letters[what])
                i += 1
            out.append(f"(?:{''.join(part)})?" if group else "".join(part))
        return "".join(out)

    def fill(self, stream: list[str]) -> list[int] | None:
        """The slot of each text of a page, in its order, or None if the page does not match.

        The regular expression tries the ways through the wrapper one after another, greedily. Where that takes long,
        the same choice is found by following all ways at once, in time linear in the page, so that the result never
        hangs on the time.
        """
        word = "".join([self.letters.get(t, "?") for t in stream])
        if "?" in word:
            return None
        try:
            m = self.pattern.fullmatch(word, timeout=0.25)
        except TimeoutError:
            return self.followed(word)
        if m is None:
            return None
        at = {s: k for k in range(len(self.known)) for s, _ in m.spans(f"s{k}")}
        return [at[i] for i, c in enumerate(word) if c == "#"]

    def followed(self, word: str) -> list[int] | None:
        if self.program is None:
            self.program = []
            self._compile(self.wrapper, iter(range(len(self.known))))
            self.program.append(("match",))
        program = self.program

        def follow(pc: int, slots: tuple | None, seen: set, into: list) -> None:
            todo = [(pc, slots)]
            while todo:
                pc, slots = todo.pop()
                if pc in seen:
                    continue
                seen.add(pc)
                step = program[pc]
                if step[0] == "split":  # the first way is the greedy one
                    todo += [(step[2], slots), (step[1], slots)]
                else:
                    into.append((pc, slots))

        now: list = []
        follow(0, None, set(), now)
        for c in word:
            new: list = []
            seen: set = set()
            for pc, slots in now:
                step = program[pc]
                if step[0] == c:
                    follow(pc + 1, (slots, step[1]) if c == "#" else slots, seen, new)
            now = new
        for pc, slots in now:
            if program[pc][0] == "match":
                out = []
                while slots is not None:
                    slots, k = slots
                    out.append(k)
                return out[::-1]
        return None

    def _compile(self, nodes: list, slots: Iterator[int]) -> None:
        i, program = 0, self.program
        while i < len(nodes):
            group, start = nodes[i][1], len(program)
            if group:
                program.append(None)
            while i < len(nodes) and nodes[i][1] == group:
                what = nodes[i][0]
                if isinstance(what, list):
                    again = len(program)
                    self._compile(what, slots)
                    program.append(("split", again, len(program) + 1))
                else:
                    program.append(("#", next(slots)) if what == TEXT else (self.letters[what],))
                i += 1
            if group:
                program[start] = ("split", start + 1, len(program))


def unrolled(nodes: list) -> list[str]:
    """A stream that the nodes cover: every group once."""
    out: list[str] = []
    for what, _ in nodes:
        out += unrolled(what) if isinstance(what, list) else [what]
    return out


def infer(skeletons: list[tuple[list, int]]) -> list[tuple[list, int]]:
    """The wrappers of a host's skeletons (or wrappers), each with the pages it stands for, taken in order.

    A skeleton is aligned with the first wrapper that can take it in without telling otherwise of a text, where
    elements around it tell, than the skeletons it covers do for themselves; where none can, there is one more template.
    """
    found: list[tuple[list, list, int]] = []
    number = [max((o for s, _ in skeletons for o in _optionals(s)), default=0)]
    for s, pages in skeletons:
        stream = unrolled(s)
        case = (stream, decisions(stream))
        for k, (wrapper, cases, n) in enumerate(found):
            if _tells(Expression(wrapper), *case):
                found[k] = (wrapper, [*cases, case], n + pages)
                break
            if _alike(unrolled(wrapper), stream):
                one = align(wrapper, s, number)
                e = Expression(one)
                if all(_tells(e, *c) for c in [*cases, case]):
                    found[k] = (one, [*cases, case], n + pages)
                    break
        else:
            found.append((s, [case], pages))
    return [(w, n) for w, _, n in found]


def _optionals(nodes: list) -> Iterator[int]:
    for what, o in nodes:
        yield o
        if isinstance(what, list):
            yield from _optionals(what)


def _tells(e: Expression, stream: list[str], want: list[int]) -> bool:
    slots = e.fill(stream)
    return slots is not None and [e.known[k] for k in slots] == want


def _alike(a: list[str], b: list[str]) -> bool:
    """Half of the tokens of the shorter one are the other's as well: pages of one template are."""
    return 2 * (Counter(a) & Counter(b)).total() >= min(len(a), len(b))


def mark(text: str) -> int:
    raw = text.encode("utf-8", "surrogatepass")
    return zlib.crc32(raw) << 31 ^ zlib.adler32(raw)


class Extractor:
    """Texts of pages by the templates of their host: [[wrapper, {slot: marks of texts that are the template's}], ...]."""

    def __init__(self, most: int = 2000):
        self.known: dict[str, list[tuple[Expression, dict]]] = {}
        self.most = most

    def templates(self, raw: str | None) -> list[tuple[Expression, dict]]:
        if not raw:
            return []
        if raw not in self.known:
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[raw] = [(Expression(w), {int(k): set(v) for k, v in common.items()}) for w, common in json.loads(raw)]
        return self.known[raw]

    def filled(self, stream: list[str], raw: str | None) -> tuple[int, list[int]] | None:
        """Which template a page has, and the slots of its texts; None if it is its own wrapper."""
        for i, (e, _) in enumerate(self.templates(raw)):
            slots = e.fill(stream)
            if slots is not None:
                return i, slots
        return None

    def __call__(self, page: str | None, raw: str | None) -> str:
        stream, texts, linked = parse(page)
        if not texts:
            return ""
        got = self.filled(stream, raw)
        if got is None:
            told, common = decisions(stream), [False] * len(texts)
        else:
            e, fixed = self.templates(raw)[got[0]]
            told = [e.known[k] for k in got[1]]
            common = [mark(t) in fixed.get(k, ()) for k, t in zip(got[1], texts, strict=True)]
        if NEUTRAL in told and KEEP not in told:
            own = [i for i, x in enumerate(told) if x == NEUTRAL]
            size = sum(len(texts[i]) for i in own)
            if sum(len(texts[i]) for i in own if common[i]) > 0.8 * size:  # copies of one page have all texts in common
                common = [False] * len(texts)
            boxes = menus(stream, texts, linked)
            keep = [i for i in own if not common[i] and not boxes[i]] or [i for i in own if not common[i]] or own
        else:
            keep = [i for i, x in enumerate(told) if x == KEEP]
        return "\n".join(texts[i] for i in keep)


BOXES = frozenset("body div section ul ol dl table td header".split())


def menus(stream: list[str], texts: list[str], linked: list[float]) -> list[bool]:
    """Of each text, whether it is in a list or box (the nearest around it) that is mostly links."""
    total: dict[int, float] = {}
    inside: dict[int, float] = {}
    owner, stack, k = [], [], 0
    for i, t in enumerate(stream):
        if t == TEXT:
            box = next((n for n, name in reversed(stack) if name in BOXES), -1)
            owner.append(box)
            total[box] = total.get(box, 0) + len(texts[k])
            inside[box] = inside.get(box, 0) + len(texts[k]) * linked[k]
            k += 1
        elif t[0] == "/":
            stack.pop()
        else:
            stack.append((i, t.split(".")[0]))
    return [inside[b] > 0.6 * total[b] for b in owner]


def skeleton_counts(pages: DataFrame) -> DataFrame:
    """host, skeleton, n of pages (host, html); null for pages too long to be aligned and for those without text."""

    def fold_all():
        def skeleton(html: str | None) -> str | None:
            stream = parse(html)[0]
            folded = fold(stream) if TEXT in stream else []
            return json.dumps(folded, separators=(",", ":")) if folded and len(unrolled(folded)) <= TOKENS else None

        return lambda html: [[skeleton(h) for h in html]]

    made = appended(pages.select("host", "html"), ["html"], "skeleton string", fold_all, without=["html"])
    return made.groupBy("host", "skeleton").agg(F.count(F.lit(1)).alias("n"))


def wrappers(counted: DataFrame) -> DataFrame:
    """(host, wrapper, n) of every host of counted skeletons, by aligning all of them in rounds of bounded groups."""

    def of_group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n", "wrapper"], ascending=[False, True])
        found = infer([(json.loads(w), int(n)) for w, n in zip(rows["wrapper"], rows["n"], strict=True)])
        return pd.DataFrame({"host": rows["host"].iloc[0], "wrapper": [json.dumps(w, separators=(",", ":")) for w, _ in found], "n": [n for _, n in found]})

    now, before = counted.where("skeleton is not null").select("host", F.col("skeleton").alias("wrapper"), "n"), None
    while True:
        parts = now.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("parts"))
        dealt = now.join(parts, "host").withColumn("part", F.pmod(F.xxhash64("wrapper"), F.col("parts")).cast("int"))
        now = written(dealt.select("host", "part", "wrapper", "n").groupBy("host", "part").applyInPandas(of_group, "host string, wrapper string, n long"), "wrappers")
        n, most = now.groupBy("host").count().agg(F.sum("count"), F.max("count")).first()
        if not n or most <= 1 or (before is not None and n > 0.9 * before) or (before is None and dealt.where("parts > 1").isEmpty()):
            return now
        before = n


SALTS = 64


def extract(pages: DataFrame) -> DataFrame:
    """Adds text (main text, blocks joined by newlines) and n_chars (code points) to pages, replacing such columns.

    ``pages`` has url and html; other columns pass through. Null and empty html, and pages without main text, give an
    empty text. Pages of null or odd urls share one host of their own. Texts in an article or main element (or an
    element named so) are main, save in menus, forms, adverts, comments and the like; where a page has no such
    element, all texts outside those are, save those of the template and menus of links. A br is white space. Whole
    pages are read, whatever their length or depth; repeated pages are extracted each; no rows give none.
    """
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.drop("text", "n_chars", "host", "wrapper", "salt").withColumn("host", host)
    counted = written(skeleton_counts(rows), "skeletons")
    by_host = counted.groupBy("host").agg(F.sum("n").alias("n"))
    total = by_host.agg(F.sum("n")).first()[0] or 0
    hot = [r["host"] for r in by_host.where(F.col("n") > max(100, total / 1000)).collect()]  # a thousand at most
    salt = F.when(F.col("host").isin(hot), F.pmod(F.xxhash64(*(c for c in rows.columns if c != "html")), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.when(F.col("host").isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    order = Window.partitionBy("host").orderBy(F.desc("n"), "wrapper")
    best = wrappers(counted).withColumn("r", F.row_number().over(order)).where(F.col("r") <= WRAPPERS)
    found = written(best.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("r", "wrapper"))).alias("w")).select("host", F.col("w.wrapper").alias("w")), "host-wrappers")

    def met(found: DataFrame, rows: DataFrame) -> DataFrame:
        salted = found.withColumn("salt", F.explode(salts))
        return rows.withColumn("salt", salt).join(salted, ["host", "salt"], "left")

    found = _with_template_texts(found, rows, met)

    def make():
        extractor = Extractor()

        def run(html: list, wrapper: list) -> list:
            texts = [extractor(h, w) for h, w in zip(html, wrapper, strict=True)]
            return [texts, [len(t) for t in texts]]

        return run

    return appended(met(found, rows), ["html", "wrapper"], "text string, n_chars long", make, rows=500, without=["wrapper", "host", "salt"])


def _with_template_texts(found: DataFrame, rows: DataFrame, met) -> DataFrame:  # noqa: ANN001
    """(host, wrapper) with the texts that the templates without a named main part share, counted over all their pages."""

    def plain():
        def run(wrappers: list[list[str]]) -> list:
            raw = [[[json.loads(w), {}] for w in ws] for ws in wrappers]
            return [[json.dumps(r, separators=(",", ":")) for r in raw], [any(Expression(w).neutral for w, _ in r) for r in raw]]

        return run

    found = written(appended(found, ["w"], "wrapper string, neutral boolean", plain, without=["w"]), "templates")
    open_ = found.where("neutral").drop("neutral")
    if open_.isEmpty():
        return found.drop("neutral")

    def slots():
        extractor = Extractor()

        def run(html: list, wrapper: list) -> list:
            out = []
            for h, w in zip(html, wrapper, strict=True):
                stream, texts, _ = parse(h)
                got = extractor.filled(stream, w) if texts and w else None
                known = extractor.templates(w)[got[0]][0].known if got else []
                out.append(sorted({(got[0], k, mark(t)) for k, t in zip(got[1], texts, strict=True) if known[k] == NEUTRAL} | {(got[0], -1, 0)}) if got else [])
            return [[[{"t": t, "s": k, "m": m} for t, k, m in x] for x in out]]

        return run

    filled = appended(met(open_, rows).where("wrapper is not null").select("host", "html", "wrapper"), ["html", "wrapper"], "x array<struct<t: int, s: int, m: long>>", slots, rows=500, without=["html", "wrapper"])
    counts = written(filled.select("host", F.explode("x").alias("x")).groupBy("host", "x.t", "x.s", "x.m").agg(F.count(F.lit(1)).alias("n")), "slot-texts")
    pages = counts.where("s = -1").select("host", "t", F.col("n").alias("pages"))
    common = counts.where("s >= 0").join(pages, ["host", "t"]).where((F.col("n") >= COMMON_PAGES) & (F.col("n") >= COMMON * F.col("pages")))
    lists = common.groupBy("host").agg(F.collect_list(F.struct("t", "s", "m")).alias("common"))  # as many as a few pages have texts

    def joined():
        def run(wrapper: list[str], common: list) -> list:
            out = []
            for w, texts in zip(wrapper, common, strict=True):
                raw = json.loads(w)
                for x in texts or ():
                    raw[x["t"]][1].setdefault(str(x["s"]), []).append(x["m"])
                out.append(json.dumps(raw, separators=(",", ":"), sort_keys=True))
            return [out]

        return run

    both = found.drop("neutral").join(lists, "host", "left").withColumnRenamed("wrapper", "plain")
    return written(appended(both, ["plain", "common"], "wrapper string", joined, without=["plain", "common"]), "templates")
