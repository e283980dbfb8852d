"""Main text of HTML pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass judges each block alone, by its length, its link
density and its density of stop words: good, bad, or, when it is short or in between, undecided. Blocks in parts
that are no article by their element or class (navigation, footers, adverts, forms, comments ...) are bad at once.
In the second pass undecided blocks take the label of the nearest decided blocks of the same part; when these
disagree or there are none, the part decides: an ``article`` or ``main`` keeps its blocks, the rest of a page doesn't.
Within an ``article`` or ``main`` a list or title of links is undecided, so that it is kept and decides for no other. A
heading goes with the block that follows it in its part, and one that stands just before kept text joins it. A short
line of copyright outside articles is bad.

Where nothing is kept, link density decides over the whole page: blocks that are in no surroundings and not mostly
links are kept; where there are none either, and no article, those under weak names (``_FAINT``) are judged by the two
passes as if they had none. A page with text in other surroundings alone has an empty text.

A class or id of surroundings is a weaker sign than an ``article`` or ``main`` that holds most of the text: such a
one, or several together on a page that has no other, are read although a class around them says no (``_released``).
Where most long text with few links has no stop words, its language is not known and link density alone decides.

White space within a block, line break elements included, becomes one space; blocks are joined by a line feed in
page order. A page is read in one pass, in time in proportion to its length however broken its tags are; a tag that
the page ends in is dropped. Null and empty pages have an empty text; rows with null ids or urls are extracted like others; repeated
rows get equal results; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from dwell.llm.shared import table

SHORT = 70
LINKS_BAD = 0.5
LINKS_LOW = 0.2
STOPS_GOOD, STOPS_SOME = 0.30, 0.15

#: Frequent function words of the languages read; a word of any of them counts.
STOP_WORDS = frozenset(
    """
    a about after all also an and any are as at be because been but by can could did do for from had has have he her his how i if in into is it
    its just like may more most no not of on one only or other our out over she so some such than that the their them then there these they
    this those to up was we were what when which who will with would you your
    aber als am an auch auf aus bei bis das dass dem den der des die doch durch ein eine einem einen einer er es für hat im in ist mit nach
    nicht noch nur oder sich sie sind so und unter vom von vor war wenn werden wie wird zu zum zur über
    au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa
    se ses son sont sur un une vous
    al como con cuando de del desde el ella en entre era es esta este ha hasta la las le lo los más me mi muy no o para pero por porque que se
    sin sobre su sus también te un una y ya
    """.split()
)

_BLOCKS = frozenset(
    """address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset
    h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav object ol option p pre search section select summary table tbody td
    tfoot th thead tr ul video audio canvas template""".split()
)
#: Their content is no text.
_RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes object select button audio video canvas".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OUT = frozenset("nav footer aside form head menu dialog search".split())
#: Words of a class or id that name surroundings wherever they stand between hyphens.
_CLASSES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|sponsor\w*|cookies?\w*|consent|gdpr|breadcrumbs?|side-?bar|"
    r"footer|comments|comment-?list|disqus|respond|repl(?:y|ies)|newsletter|subscribe|"
    r"sign-?up|login|pop-?up|modal|overlay|widget|pagination|pager|copyright|toolbar)(?:$|[\s_-])",
    re.I,
)
#: Words that do so alone or beside words of place and of lists only: a site-header is none of the text, and a
#: post-header, related-work or menu-description may be, so density decides there.
_FAINT = re.compile(r"(?:nav|navs|navbars?|navigation|menus?|menubar|comment|header|masthead|notice|alert|promo\w*|share|sharing|social|related|recommend\w*)", re.I)
_BESIDE = frozenset(
    """site page top main global bottom left right box bar block list lists link links posts articles stories items item topics news reading content
    buttons button icons icon media section container wrapper wrap inner outer area row col panel primary secondary mobile desktop toggle dropdown text
    body author meta form thread avatar date count user users reader readers""".split()
)
#: A line of copyright.
_RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b)\s*(?:©|\(c\))?\s*(?:\d{4}|by\b)|.*\ball rights reserved\W*$", re.I)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: A class or id of the text itself.
_TEXT_OF = re.compile(r"(?<!\S)(?:article|main|(?:main|article|post|entry|story|page)[-_]?(?:content|body|text))(?!\S)", re.I)
#: Names that tell of a page's layout, not of the element: has-sidebar, no-footer ...
_LAYOUT = re.compile(r"(?<!\S)(?:has|no|with|without|layout)[-_]\S*", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: How a tag, a comment or a declaration begins; the rest of a tag, its quoted values skipped, without stepping back.
_HEAD = re.compile(r"<(?:(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)|[!?/](?=[^a-zA-Z]|(?<=[!?])))")
_REST = re.compile(r"""[^"'>]*+(?:(?:"[^"]*"|'[^']*')[^"'>]*+)*+>""")
#: Tags of a page whose quotes may run to its end before quotes no longer count: this bounds what is read twice.
_MISSES = 16
_LONG_REFERENCE = re.compile(r"&#\d{8,};?")
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CLOSES = {  # an opening tag that ends an open element of the same list
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"},
}
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW}
_P_ENDS = _BLOCKS - {"li", "dt", "dd", "tr", "td", "th", "option", "body", "html", "head", "p", "button", "select"}


@dataclass
class Block:
    part: int
    text: list[str] = field(default_factory=list)
    linked: int = 0
    content: bool = False  # within an article or main element
    out: bool = False  # within a part that is no article by its element, role or style
    named: int = 0  # the innermost element around it whose class or id is of surroundings
    held: int = 0  # the outermost article or main within that element
    weak: bool = False  # only weak names around it
    heading: bool = False


@dataclass(frozen=True)
class _Place:
    """Where an open element is: the same as in Block."""

    content: bool = False
    out: bool = False
    named: int = 0
    held: int = 0
    weak: bool = False


def _sign(value: str) -> str:
    """"named" for a class or id of surroundings, "weak" for one by weak words alone, "faint" for one that may be of
    surroundings, "text" for one of the text."""
    value = _LAYOUT.sub(" ", value)
    if _CLASSES.search(value):
        return "named"
    faint = ""
    for token in value.split():
        words = re.split(r"[-_]+", token)
        if any(map(_FAINT.fullmatch, words)):
            if all(_FAINT.fullmatch(w) or w.lower() in _BESIDE or w.isdigit() or not w for w in words):
                return "weak"
            faint = "faint"
    return faint or ("text" if _TEXT_OF.search(value) else "")


def _outside(name: str, attrs: str, in_content: bool) -> str:
    """"out" by element, role or style; or the sign of its class and id; else nothing."""
    if name in _OUT or name == "header" and not in_content:
        return "out"
    if not attrs or name in ("html", "body", "main", "article"):
        return ""
    signs = set()
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
            return "out"
        if key == "role" and value.lower() in _ROLES:
            return "out"
        if key in ("class", "id"):
            signs.add(_sign(value))
    return next((s for s in ("named", "weak", "faint", "text") if s in signs), "")


def _unescape(text: str) -> str:
    return html.unescape(_LONG_REFERENCE.sub("\ufffd", text)) if "&" in text else text


class _Tags:
    """The tags of a page from left to right: (start, end, whether it closes, lower-case name, attributes, text of its
    own), or None after the last.

    A tag that the page breaks off in ends it. A tag with a quote that never ends goes to its first ``>``.
    """

    def __init__(self, page: str) -> None:
        self._page, self._misses, self._last = page, 0, page.rfind(">")

    def after(self, at: int) -> tuple[int, int, bool, str, str, str] | None:
        page = self._page
        m = _HEAD.search(page, at)
        if m is None:
            return None
        lo, n = m.start(), len(page)
        if m["name"] is None:
            if page.startswith("<![CDATA[", lo):
                end = page.find("]]>", lo + 9)
                return (lo, n, False, "", "", page[lo + 9 :]) if end < 0 else (lo, end + 3, False, "", "", page[lo + 9 : end])
            mark = "-->" if page.startswith("<!--", lo) else ">"
            end = page.find(mark, lo + 2 + 2 * (mark != ">"))
            return lo, n if end < 0 else end + len(mark), False, "", "", ""
        if lo > self._last:
            return lo, n, False, "", "", ""
        rest = _REST.match(page, m.end()) if self._misses < _MISSES else None
        if rest is None:
            self._misses += 1
            end = page.index(">", m.end()) + 1
        else:
            end = rest.end()
        return lo, end, m["close"] == "/", m["name"].lower(), page[m.end() : end - 1], ""


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, _Place, int]] = []  # name, place, part
    top = ("", _Place(), 0)
    parts = elements = 0
    links = 0
    now: Block | None = None
    opened: Counter[str] = Counter()  # open elements by name

    def cut() -> None:
        nonlocal now
        if now is not None and any(map(str.strip, now.text)):
            out.append(now)
        now = None

    def add(text: str) -> None:
        nonlocal now
        if not text:
            return
        if now is None:
            if text.isspace():
                return
            name, place, part = stack[-1] if stack else top
            now = Block(part, content=place.content, out=place.out, named=place.named, held=place.held, weak=place.weak, heading=name in _HEADINGS)
        now.text.append(text)
        if links:
            now.linked += len(text.strip())

    def element(name: str, close: bool, attrs: str) -> None:
        nonlocal links, parts, elements
        if name in _BLOCKS:
            cut()
        if close:
            if name == "a":
                links = max(0, links - 1)
            elif name in _BLOCKS:
                if opened[name]:
                    while True:
                        last = stack.pop()[0]
                        opened[last] -= 1
                        if last == name:
                            break
                links = 0
            return
        if name == "a":
            links += 1
            return
        if name in _VOID or name not in _BLOCKS or attrs.endswith("/") and name not in _BLOCKS:
            return
        links = 0
        ends = _CLOSES.get(name) or ({"p"} if name in _P_ENDS else ())
        while stack and stack[-1][0] in ends:
            opened[stack.pop()[0]] -= 1
        _, place, part = stack[-1] if stack else top
        elements += 1
        sign = _outside(name, attrs, place.content)
        main = name in ("article", "main") or sign == "text"
        out_ = place.out or sign == "out"
        named, held, weak = (elements, 0, sign == "weak" and (place.weak or not place.named)) if sign in ("named", "weak") else (place.named, place.held, place.weak)
        if main and named and not held and sign != "text":
            held = elements
        # what is in an element of surroundings is no content, but for what its articles hold
        content = not out_ and (held > 0 if named else place.content or main)
        here = _Place(content, out_, named, held, weak)
        if name == "article" and not out_ or here != place or sign == "faint":
            parts += 1
            part = parts
        stack.append((name, here, part))
        opened[name] += 1

    endless: set[str] = set()  # raw elements that are not closed any more
    at, tags = 0, _Tags(page)
    while (tag := tags.after(at)) is not None:
        start, end, close, name, attrs, own = tag
        add(_unescape(page[at:start]))
        at = end
        if own:
            add(own)
        if name == "br":
            add(" ")
        elif name in _RAW and not close:
            if name in _BLOCKS:
                cut()
            if not attrs.endswith("/") and name not in endless:
                found = _RAW_END[name].search(page, at)
                if found:
                    at = found.end()
                elif name in ("script", "style"):
                    at = len(page)
                else:
                    endless.add(name)
        elif name:
            element(name, close, attrs)
    add(_unescape(page[at:]))
    cut()
    return out


def _released(found: list[tuple[Block, str]]) -> set[int]:
    """Elements of surroundings whose articles are read: an article or main holds most of the text of the page that is
    not in other surroundings, or all of the element's together do and the page has no other."""
    own: dict[int, list] = {}  # text, and that of each article
    plain, article = 0, False
    for b, t in found:
        if b.out:
            continue
        if not b.named:
            plain += len(t)
            article = article or b.content
            continue
        of = own.setdefault(b.named, [0, {}])
        of[0] += len(t)
        if b.held:
            of[1][b.held] = of[1].get(b.held, 0) + len(t)
    free = set()
    for k in sorted(own):  # outer elements first: what they let go is the page's own text for inner ones
        total, held = own[k]
        most = max(held.values(), default=0) if article else sum(held.values())
        if 2 * most > plain + total:
            free.add(k)
            plain += sum(held.values())
            article = True
    return free


def judge(text: str, block: Block, free: set[int] | frozenset[int] = frozenset()) -> bool | None:
    """True: good. False: bad. None: undecided."""
    if block.out or block.named and not (block.held and block.named in free):
        return False
    if block.linked > LINKS_BAD * len(text):
        return None if block.content else False
    if len(text) < SHORT:
        return None if block.content or not _RIGHTS.match(text) else False
    stops = _stops(text)
    if stops >= STOPS_GOOD:
        return True
    # without stop words it may be a language whose words aren't known; few words over and over are a list
    return None if stops >= STOPS_SOME or block.content or not _repeats(text) else False


def _repeats(text: str) -> bool:
    words = text.lower().split()
    return 2 * len(set(words)) < len(words) ** 0.8  # distinct words grow slower than the text


def _stops(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()[]*#$%&|") in STOP_WORDS for w in words) / len(words)


def _passes(found: list[tuple[Block, str]]) -> list[bool]:
    """Whether each block is kept."""
    free = _released(found)
    first = [judge(t, b, free) for b, t in found]
    # long text without stop words outside articles: where it is more than the good text, density decides
    strange = [k for k, (b, t) in enumerate(found) if first[k] is None and not b.content and len(t) >= SHORT and _stops(t) < STOPS_SOME]
    if sum(len(found[k][1]) for k in strange) > sum(len(t) for (_, t), good in zip(found, first, strict=True) if good):
        for k in strange:
            first[k] = found[k][0].linked <= LINKS_LOW * len(found[k][1])
    label = list(first)
    lo = 0
    while lo < len(found):
        hi = lo
        while hi < len(found) and found[hi][0].part == found[lo][0].part:
            hi += 1
        decided = [k for k in range(lo, hi) if first[k] is not None]
        before = -1
        for k in range(lo, hi):
            if first[k] is not None:
                before += 1
                continue
            left = decided[before] if before >= 0 else None
            right = decided[before + 1] if before + 1 < len(decided) else None
            near = [first[j] for j in (left, right) if j is not None]
            if len(near) == 2 and found[k][0].heading:
                near = near[1:]
            elif len(near) == 2 and near[0] != near[1] and k - left != right - k:
                near = near[:1] if k - left < right - k else near[1:]
            label[k] = near[0] if near and near.count(near[0]) == len(near) else found[k][0].content
        lo = hi
    for k in range(len(found) - 2, -1, -1):
        # a heading that nothing of its own part speaks for or against, just before kept text
        if found[k][0].heading and first[k] is None and not label[k] and label[k + 1]:
            label[k] = True
    return label


def extract(page: str | None) -> str:
    found = [(b, t) for b in blocks(page or "") if (t := " ".join("".join(b.text).split()))]
    keep = _passes(found)
    if not any(keep):
        keep = [not (b.out or b.named) and b.linked <= LINKS_BAD * len(t) and not (len(t) < SHORT and _RIGHTS.match(t)) for b, t in found]
    if not any(keep) and not any(b.content for b, _ in found):
        keep = _passes([(replace(b, named=0) if b.weak else b, t) for b, t in found])
    return "\n".join(t for (_, t), kept in zip(found, keep, strict=True) if kept)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    rows = pages.select("page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p.as_py()) for p in batch["html"]]
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op9_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
