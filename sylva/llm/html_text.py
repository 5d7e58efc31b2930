"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering.

A page streams through the standard library's HTML parser once. Its events are folded into lines, one
for each run of text between block borders, with the number of tags the line holds and the open elements
around it. Each line has a ratio of text characters to tags; the ratios are smoothed with a Gaussian
kernel over neighbouring lines and split into two clusters by a threshold at a multiple of their standard
deviation. Lines of the upper cluster, outside of boilerplate elements, are seeds. The content region is
the innermost container that holds all seeds, and all of its lines outside of boilerplate elements are the
main text, short ones too. So are the lines around it, except menus and side columns without a mark: lines that are nothing
but links, no heading, and whose own ratio lies in the lower cluster; and rows of ``COLUMN`` or more lines of the lower cluster that
are no headings or paragraphs, of which half are links or none ends a sentence. Menus do not widen the region.

Where elements and class names mark the boilerplate, these marks decide, as ratios cannot tell a dense advert or a
long footer from an article; the clusters decide where there are no marks.

Defined results: a null or empty page, and a page with no text outside of boilerplate, gives an empty
text. A page without any tag is one block. Unclosed and misnested elements close with the element around
them; a tag or comment that the end of the page cuts off is dropped. Pages of any length and depth of nesting take time in proportion to
their length. An empty table gives an empty result. Repeated rows are treated one by one alike. Other columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from sylva.llm.common import map_arrow, pick

# Element names of HTML, and words that sites use in class and id for what is no article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav noscript object ol optgroup option p pre script section select style "
    "summary svg table tbody td template textarea tfoot th thead title tr ul video audio canvas".split()
)
NEVER = frozenset(
    "aside audio button canvas dialog footer form head header iframe input menu nav noscript object optgroup option script select style svg "
    "template textarea title video".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINER = frozenset("article main section div td body blockquote".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising alert announcement aside banner breadcrumb breadcrumbs comment comments commentlist consent "
    "cookie cookies copyright disclaimer discussion disqus feedback foot footer form gdpr header legal login masthead menu menus modal nav navbar "
    "navigation navi newsletter notice notices notification overlay pager pagination paywall popup privacy promo promoted promotion rail recommend "
    "recommendations recommended related replies reply respond search share sharing shares sidebar sidenav signup skip skyscraper social sponsor "
    "sponsored subscribe subscription tagcloud tags toc toolbar topbar warning widget widgets".split()
)
#: Words that say what else is on the page, or is not: ``has-sidebar`` is no sidebar.
ABOUT = frozenset("has with no without".split())
CLOSES_P = BLOCK - frozenset("body html head script style template title".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_WORDS = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WHITE = re.compile(r"\s+")
_CUT_OFF = re.compile(r"</?[a-zA-Z]|<[!?]")
_SENTENCE = re.compile(r"[.!?…。！？:]['\")\]»”’]*$")
#: Smoothing: kernel radius in lines and its deviation.
RADIUS, SIGMA = 2, 1.0
#: The threshold between the clusters, in standard deviations of the smoothed ratios.
THRESHOLD = 0.5
#: Lines of a side column at least.
COLUMN = 3
#: Elements of running text.
PROSE = HEADING | frozenset("p blockquote pre figcaption caption dt dd summary".split())
_P_STOPS = (CONTAINER | {"button", "li", "table"}) - {"p"}
_LIST_STOPS = frozenset("ul ol dl table select menu".split())


def _is_noise(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    if tag in NEVER:
        return True
    if tag in ("html", "body", "article", "main") and not any(k in ("class", "id", "role", "hidden", "style", "aria-label") for k, _ in attrs):
        return False
    for k, v in attrs:
        if k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and "display:none" in v.replace(" ", "").lower():
            return True
        if not v:
            continue
        if k == "role" and v.lower() in ROLES:
            return True
        if k in ("class", "id", "aria-label") and tag not in ("html", "body", "main"):
            for name in v.split():
                words = _WORDS.findall(_CAMEL.sub(" ", name).lower())
                if not NOISE.isdisjoint(words) and ABOUT.isdisjoint(words):
                    return True
    return False


class Line:
    """A run of text between block borders."""

    __slots__ = ("text", "tags", "noise", "container", "linked", "prose")

    def __init__(self, text: str, tags: int, noise: bool, container: int, linked: bool, prose: bool) -> None:
        self.text, self.tags, self.noise, self.container, self.linked, self.prose = text, tags, noise, container, linked, prose


class LineParser(HTMLParser):
    """Folds parser events into lines; containers are numbered as they open, and know the one around them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.stack: list[tuple[str, bool, int, bool]] = []  # element, noise here, container id or 0, link
        self.open: dict[str, list[int]] = {}  # places in the stack of each open element
        self.around = [0]  # container -> the container that holds it
        self.inside = [0]  # containers that are open
        self.noise = self.links = self.headings = self.prose = 0
        self.parts: list[str] = []
        self.plain = False  # text outside of links
        self.tags = 0

    def _flush(self) -> None:
        if self.parts:
            text = _WHITE.sub(" ", "".join(self.parts)).strip()
            if text:
                self.lines.append(Line(text, self.tags, self.noise > 0, self.inside[-1], not self.plain and not self.headings, self.prose > 0))
            self.parts = []
            self.plain = False
        self.tags = 0

    def _count(self, tag: str, noise: bool, link: bool, step: int) -> None:
        self.noise += noise * step
        self.links += link * step
        self.headings += (tag in HEADING) * step
        self.prose += (tag in PROSE) * step

    def _pop(self) -> None:
        tag, noise, number, link = self.stack.pop()
        self.open[tag].pop()
        if number:
            self.inside.pop()
        self._count(tag, noise, link, -1)

    def _last(self, tags) -> int:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def handle_starttag(self, tag, attrs):
        block = tag in BLOCK
        if block:
            self._flush()
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag in CLOSES_P:
            self._close(("p",), _P_STOPS)
        if tag in SIBLINGS:
            self._close(SIBLINGS[tag], _LIST_STOPS)
        noise = _is_noise(tag, attrs)
        number = 0
        if tag in CONTAINER:
            number = len(self.around)
            self.around.append(self.inside[-1])
            self.inside.append(number)
        link = tag == "a" and any(k == "href" for k, _ in attrs)
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, noise, number, link))
        self._count(tag, noise, link, 1)

    def _close(self, these, stop) -> None:
        """Close the nearest open element of ``these`` unless one of ``stop`` is nearer."""
        at = self._last(these)
        if at > self._last(stop):
            while len(self.stack) > at:
                self._pop()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self._flush()
        self.tags += 1
        if tag not in VOID and self.open.get(tag):
            self._close((tag,), ())

    def handle_data(self, data):
        self.parts.append(data)
        if not self.links and not data.isspace():
            self.plain = True

    def finish(self, html: str) -> None:
        self.feed(html)
        if _CUT_OFF.match(self.rawdata):
            self.rawdata = ""  # the page ends inside of a tag or comment
        self.close()
        self._flush()

    def common(self, containers: set[int]) -> int:
        """The innermost container that holds all of ``containers``; 0 is the page. Outer containers have smaller numbers."""
        left = [-c for c in containers]
        heapq.heapify(left)
        while left:
            last = -heapq.heappop(left)
            while left and -left[0] == last:
                heapq.heappop(left)
            if not left:
                return last
            heapq.heappush(left, -self.around[last])
        return 0

    def within(self, region: int) -> list[bool]:
        """Of each container, whether ``region`` is or holds it."""
        out = [region == 0] * len(self.around)
        for number in range(1, len(out)):
            out[number] = number == region or out[self.around[number]]
        return out


def smoothed_ratios(lines: list[tuple[str, int]]) -> list[float]:
    """Gaussian smoothing of text characters per tag over neighbouring lines."""
    ratios = [len(text) / max(1, tags) for text, tags in lines]
    kernel = [math.exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-RADIUS, RADIUS + 1)]
    out = []
    for i in range(len(ratios)):
        total = weight = 0.0
        for k, w in enumerate(kernel):
            if 0 <= (j := i + k - RADIUS) < len(ratios):
                total += w * ratios[j]
                weight += w
        out.append(total / weight)
    return out


def side_columns(lines: list[Line], low: list[int]) -> set[int]:
    """Those of the lines ``low`` (places in page order) that make menus and side columns without a mark."""
    out, i = set(), 0
    while i < len(low):
        j = i + 1
        while j < len(low) and low[j] == low[j - 1] + 1:
            j += 1
        row = low[i:j]
        if len(row) >= COLUMN and (2 * sum(lines[k].linked for k in row) >= len(row) or not any(_SENTENCE.search(lines[k].text) for k in row)):
            out.update(row)
        i = j
    return out


def main_blocks(html: str | None) -> list[str]:
    """The blocks of the main text in page order."""
    if not html:
        return []
    parser = LineParser()
    parser.finish(html)
    lines = parser.lines
    if not lines:
        return []
    smooth = smoothed_ratios([(x.text, x.tags) for x in lines])
    mean = sum(smooth) / len(smooth)
    spread = math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth))
    clean = [i for i, x in enumerate(lines) if not x.noise]
    seeds = [i for i in clean if smooth[i] >= THRESHOLD * spread] or clean
    if not seeds:
        return []
    own_low = [len(x.text) / max(1, x.tags) < THRESHOLD * spread for x in lines]
    menu = {i for i in clean if lines[i].linked and own_low[i]}
    told = [i for i in seeds if i not in menu and not own_low[i]] or [i for i in seeds if i not in menu] or seeds
    inside = parser.within(parser.common({lines[i].container for i in told}))
    outside = [i for i in clean if not inside[lines[i].container]]
    dropped = menu.intersection(outside) | side_columns(lines, [i for i in outside if own_low[i] and not lines[i].prose])
    return [lines[i].text for i in clean if inside[lines[i].container] or i not in dropped]


def main_text(html: str | None) -> str:
    return "\n\n".join(main_blocks(html))


def extract(pages: DataFrame, *, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns, the main text as ``text`` and its length in code points as ``n_chars``."""
    rows = pick(pages, *keep, html).toDF(*keep, "html")

    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keep, "text", "n_chars"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return map_arrow(rows, run, f"{schema}, text string, n_chars long")
