"""Main text of web pages by the maximum-scoring subsequence of their tokens.

A page is a sequence of text runs and tags. Words score positive, tags negative; the cost of each tag comes from
labelled pages (log odds of being outside the labelled region against inside). One linear scan finds the best contiguous
region, and its text is the result.

Elements are evidence. Only raw text (scripts, styles and the like) is removed outright. An element whose tag, role,
class or id names boilerplate is a suspect: its words do not score, and it costs a little as a whole, so that a region may
go on behind it. A class or id is such a name if all its parts are ("comments", "cookie-notice", "site-footer"); one that
only has such a part ("has-sidebar", "comments-open") makes its own tags dearer and no more. If no other sentence is left on the
page, the suspect with the most prose is cleared, and so on inside it: a form or a "reviews" block around the whole
text is its text. On pages that mark content (main or article), as long as that holds a share of the words, what lies
between content elements is such a block as well, and tags inside them cost next to nothing; several articles make one region.

Elements end as HTML says: p, li, dt, dd, option, tr, td and th may leave out their end tags.

Labelled pages are those that mark their content themselves, with an article or main element; the costs are fitted on at
most most_labelled of them, those with the smallest hashes of their ids.

Edge cases: null and empty html, and pages without words, give the empty text; unclosed elements end with the page;
each input row gives one row; characters are code points; white space is any Unicode white space.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
# Names of elements by their part in HTML, and words in names, classes, ids and roles that mark boilerplate.
RAW = frozenset("script style textarea title noscript iframe xmp template".split())
NEVER = frozenset("head nav footer aside button select menu dialog svg canvas object audio video map datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CONTENT = frozenset(("article", "main"))
ENDS_P = frozenset("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
SCOPE = frozenset("html body table caption td th button object template".split())
ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "optgroup": ("option", "optgroup"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("td", "th", "tr", "thead", "tbody", "tfoot"), "thead": ("td", "th", "tr", "tbody"), "tfoot": ("td", "th", "tr", "thead", "tbody"), "body": ("head",)}
INSIDE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select", "datalist"), "optgroup": ("select",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "tbody": ("table",), "thead": ("table",), "tfoot": ("table",), "body": ("html",)}
NAMES = re.compile(r"(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|side-?bar|nav\w*|menu\w*|breadcrumbs?|footer|masthead|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscribe|signup|comments?|respond|disqus|replies|reply|reviews?|share|sharing|social|related|recommended|recommendations|pagination|pager|widgets?|toolbar|login|search)\Z")
NEUTRAL = frozenset("site page top bottom left right main primary secondary global inner outer box block area list lists wrap wrapper container section bar links link items item posts post articles stories content form group row col panel thread header".split())
NAMED = frozenset("site-header page-header top-bar topbar site-head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
LEAST, WALL, DROP = 0.3, 2.0, 0.5  # in words: the least cost of a tag (and of unknown ones), the greatest, and that of a suspect or a gap as a whole
SURE = 0.02  # in words: the cost of either where the page marks its content itself
MARKED_SHARE, SENTENCE = 0.2, 4  # content elements count if they have this share of the words; words of a run that is prose
CLEAR, WEAK, CLEARABLE, FINAL = range(4)  # how an element is marked: not, a part of a name, by a name, by what can hold no main text


def marking(name: str, attributes: str, inside: bool) -> int:
    """How an element is marked as boilerplate; inside: whether it is in a content element."""
    if name in NEVER or name == "header" and not inside:
        return FINAL
    out = CLEARABLE if name == "form" else CLEAR
    if not attributes or name in ("html", "body") or name in CONTENT and not inside:
        return out
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return FINAL
        if key == "role":
            out = max(out, CLEARABLE * (value in ROLES))
        elif key in ("class", "id"):
            out = max(out, *(name_marking(x) for x in value.split()), CLEAR)
    return out


def name_marking(name: str) -> int:
    if name in NAMED or NAMES.match(name):
        return CLEARABLE
    parts = re.split("[-_]+", name)
    named = [bool(NAMES.match(p)) for p in parts]
    if not any(named):
        return CLEAR
    return CLEARABLE if all(n or p in NEUTRAL for n, p in zip(named, parts)) else WEAK


class Page:
    """The tokens of a page: kind ("text" or "tag"), value (a run, or name and /name), suspects (open ones, outermost first), inside (content elements), weak, and plain (whether in no link and no heading)."""

    def __init__(self, page: str):
        self.tokens: list[tuple] = []
        self.final: dict[int, bool] = {}  # of each suspect: whether it stays one
        self.stack: list[list] = []  # name, suspect's number or None, weak
        self.open: tuple[int, ...] = ()
        self.depth = self.quiet = 0
        self.read(page)

    def pop(self, at: int) -> None:
        for name, suspect, _ in self.stack[at:]:
            if suspect is not None:
                self.open = tuple(s for s in self.open if s != suspect)
            self.depth -= name in CONTENT
            self.quiet -= name == "a" or name in HEADINGS
        del self.stack[at:]

    def end_p(self) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == "p":
                return self.pop(i)
            if self.stack[i][0] in SCOPE:
                return None
        return None

    def end(self, name: str) -> bool:
        """Ends an element; whether it was marked weakly."""
        if name in ("body", "html"):
            self.pop(0)
            return False
        for i in range(len(self.stack) - 1, -1, -1):
            own, _, weak = self.stack[i]
            if own == name:
                if name in INLINE and any(s[0] not in INLINE for s in self.stack[i + 1 :]):
                    rest = self.stack[i + 1 :]
                    self.pop_one(i, rest)
                else:
                    self.pop(i)
                return weak
            if own in SCOPE and own not in ("html", "body") and name not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "caption", "button", "object") and name not in CONTENT:
                return False
        return False

    def pop_one(self, at: int, rest: list[list]) -> None:
        name, suspect, _ = self.stack[at]
        if suspect is not None:
            self.open = tuple(s for s in self.open if s != suspect)
        self.quiet -= name == "a" or name in HEADINGS
        self.stack[at:] = rest

    def start(self, name: str, attributes: str) -> bool:
        if name in ENDS_P:
            self.end_p()
        if name in ENDED_BY:
            for i in range(len(self.stack) - 1, -1, -1):
                own = self.stack[i][0]
                if own in INSIDE[name]:
                    break
                if own in ENDED_BY[name]:
                    first = i
                    while first and self.stack[first - 1][0] in ENDED_BY[name] and self.stack[first - 1][0] not in INSIDE[name]:
                        first -= 1
                    self.pop(first)
                    break
        if name in CONTENT or name not in HEAD:
            self.end_unclosed(name)
        how = marking(name, attributes, self.depth > 0)
        if name in VOID or attributes.endswith("/"):
            return False
        suspect = None
        if how >= CLEARABLE:
            suspect = len(self.final)
            self.final[suspect] = how == FINAL
            self.open = (*self.open, suspect)
        self.stack.append([name, suspect, how == WEAK])
        self.depth += name in CONTENT
        self.quiet += name == "a" or name in HEADINGS
        return how == WEAK

    def end_unclosed(self, name: str) -> None:
        """A head ends with the first element that it cannot hold, menus with an article, and page parts with main."""
        ended = {"head"} | ({"nav", "menu", "header", "footer", "aside"} if name == "main" else {"nav", "menu"} if name == "article" else set())
        for i, (own, _, _) in enumerate(self.stack):
            if own in ended:
                return self.pop(i)
        return None

    def read(self, page: str) -> None:
        pos, n, add = 0, len(page), self.tokens.append
        while pos < n:
            m = MARKUP.search(page, pos)
            upto = m.start() if m else n
            if upto > pos:
                run = page[pos:upto]
                if self.stack and self.stack[-1][0] == "head" and run.strip():
                    self.pop(len(self.stack) - 1)
                add(("text", run, self.open, self.depth > 0, False, not self.quiet))
            if m is None:
                break
            pos = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                was, inside = self.open, self.depth > 0
                weak = self.end(name)
                add(("tag", "/" + name, was, inside, weak, False))
            else:
                if name in RAW:  # raw text ends with its own end tag only
                    end = re.compile(f"</{re.escape(name)}\\s*>", re.I).search(page, pos)
                    pos = end.end() if end else n
                    add(("text", " ", self.open, self.depth > 0, False, False))
                    continue
                weak = self.start(name, m[3])
                add(("tag", name, self.open, self.depth > 0, weak, False))


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HEAD = frozenset("html head base link meta script style title template noscript".split())


def cleared(tokens: list[tuple], final: dict[int, bool]) -> frozenset[int]:
    """The suspects that are cleared: while no other run of prose is left, the one with the most prose directly in it."""
    out: set[int] = set()
    runs = [(len(v.split()), open_) for kind, v, open_, _, _, plain in tokens if kind == "text" and plain]
    while True:
        prose: dict[int, int] = defaultdict(int)
        for n, open_ in runs:
            left = [s for s in open_ if s not in out]
            if n >= SENTENCE and not left:
                return frozenset(out)
            if left and not any(final[s] for s in left):
                prose[left[0]] += n if len(left) == 1 else 0
        best = max(prose.items(), key=lambda x: (x[1], -x[0]), default=(None, 0))
        if best[0] is None or not any(n >= SENTENCE and best[0] in open_ and not any(final[s] for s in open_) for n, open_ in runs):
            return frozenset(out)
        out.add(best[0])


def scored(page: Page, cost: dict[str, float]) -> tuple[list[float], list[bool]]:
    """The score of each token, and whether it belongs to the text if it is in the region."""
    clear = cleared(page.tokens, page.final)
    marked, scores, own = in_marked(page, clear), [], []
    last = None
    for kind, value, open_, inside, weak, _ in page.tokens:
        left = next((s for s in open_ if s not in clear), None)
        block = left if left is not None else "gap" if marked and not inside else None
        own.append(block is None)
        if block is not None:
            scores.append(-(SURE if marked else DROP) if block != last else 0.0)
        elif kind == "text":
            scores.append(float(len(value.split())))
        else:
            scores.append(-SURE if marked else -cost.get(value, LEAST) - WALL * weak)
        if block is not None or kind == "text" and value.strip():
            last = block
    return scores, own


def in_marked(page: Page, clear: frozenset[int]) -> bool:
    """Whether the page's content elements have their share of its words."""
    words = {True: 0, False: 0}
    for kind, value, open_, inside, _, _ in page.tokens:
        if kind == "text" and all(s in clear for s in open_):
            words[inside] += len(value.split())
    return words[True] > 0 and words[True] >= MARKED_SHARE * (words[True] + words[False])


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and last + 1 of the contiguous scores with the greatest sum; (0, 0) if no sum is above 0."""
    best = here = 0.0
    at, start, end = 0, 0, 0
    for i, x in enumerate(scores):
        here += x
        if here <= 0:
            here, at = 0.0, i + 1
        elif here > best:
            best, start, end = here, at, i + 1
    return start, end


def extract_text(page: str, cost: dict[str, float]) -> str:
    read = Page(page)
    scores, own = scored(read, cost)
    start, end = best_region(scores)
    parts = []
    for (kind, value, *_), mine in zip(read.tokens[start:end], own[start:end]):
        parts.append(" " if not mine else html.unescape(value) if kind == "text" else "" if value.lstrip("/") in INLINE else " ")
    return " ".join("".join(parts).split())


def marks(page: str) -> tuple[Counter, Counter] | None:
    """Tags inside and outside of the page's own content elements; None if it has none. Suspects inside count as neither."""
    inside, outside, any_content = Counter(), Counter(), False
    for kind, value, open_, own, _, _ in Page(page).tokens:
        if kind == "tag" and value.lstrip("/") in CONTENT:
            any_content = True
        elif kind == "tag" and not (own and open_):
            (inside if own else outside)[value] += 1
    return (inside, outside) if any_content else None


def weights(inside: Counter, outside: Counter) -> dict[str, float]:
    """Cost of each tag in words, from LEAST to WALL: the log odds of being outside the content."""
    all_in, all_out = sum(inside.values()) + 1, sum(outside.values()) + 1
    return {t: min(WALL, max(LEAST, LEAST + math.log(((outside[t] + 0.5) / all_out) / ((inside[t] + 0.5) / all_in)))) for t in inside.keys() | outside.keys()}


def train(pages: DataFrame, page_id: str = "page_id", page: str = "html", most_labelled: int = 2_000) -> dict[str, float]:
    """weights() of the labelled pages."""
    labelled = pages.select(F.col(page_id).alias("id"), F.col(page).alias("html")).where(F.lower("html").rlike("<(article|main)[ >]"))
    chosen = labelled.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(most_labelled)
    labelled = labelled.join(F.broadcast(chosen), "id").select("html")

    def run(batches):
        inside, outside = Counter(), Counter()
        for batch in batches:
            for x in batch.column(0).to_pylist():
                if got := marks(x):
                    inside += got[0]
                    outside += got[1]
        tags = sorted(inside.keys() | outside.keys())
        yield pa.RecordBatch.from_pydict({"tag": pa.array(tags, pa.string()), "n_in": pa.array([inside[t] for t in tags], pa.int64()), "n_out": pa.array([outside[t] for t in tags], pa.int64())})

    rows = labelled.mapInArrow(run, "tag string, n_in long, n_out long").groupBy("tag").agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out")).orderBy("tag").collect()
    return weights(Counter({r.tag: r.n_in for r in rows}), Counter({r.tag: r.n_out for r in rows}))


def extract(pages: DataFrame, cost: dict[str, float] | None = None, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    cost = train(pages, page_id, page) if cost is None else cost

    def run(batches):
        for batch in batches:
            texts = [extract_text(x or "", cost) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
