"""Main text of web pages by the distribution of text over blocks of lines.

Markup is stripped so that every block element gives one line; a container that can't hold the
article (menus, forms, adverts and so on, by element, role or class) gives none, unless there is an article
or main in it. If a page marks its article, the lines in it are the main text.

Else the text lengths of ``WINDOW`` lines in a row, links not counted, are summed at every line. The text
surges where a sum exceeds ``SURGE``, or half of the largest sum if none does, and dives where a sum is zero.
All lines from the first surge to the last dive are the main text, and so are, before and after, the paragraphs,
headings and other lines with text outside links that stand in the same container as lines found so.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphrecon.llm.batches import add_columns

WINDOW, SURGE = 3, 86

_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^"'<>]|"[^"]*"|'[^']*')*)>|<[!?/][^<>]*>""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
# Element names of HTML by what they mean here.
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
# Lines of a page stand in these; what other blocks hold belongs to the one around them.
_CONTAINERS = frozenset("article body center details div fieldset form main section td".split())
_PARAGRAPHS = frozenset("blockquote h1 h2 h3 h4 h5 h6 p pre".split())
_NEVER = frozenset(
    "head title noscript template iframe object svg canvas audio video map nav aside footer form button select "
    "textarea dialog menu".split()
)
# What stands in these is no element of the page.
_RAW = frozenset("title template iframe textarea select".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
_CLASSES = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent "
    "disqus footer masthead menu modal nav navbar navigation newsletter notice pagination popup promo "
    "promotion related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
# Names of two words that mean the same; any other name that has one of the words above in it means nothing.
_COMPOUNDS = frozenset(
    f"{first}-{second}"
    for firsts, seconds in (
        (
            "ad ads advert adverts advertisement advertising",
            "area banner block box break container frame holder inline label placeholder slot space unit wrap wrapper",
        ),
        ("banner display google native sidebar sponsored text", "ad ads"),
        ("bottom footer global main mobile page primary secondary site top", "footer masthead menu nav navbar navigation"),
        ("nav navbar menu navigation", "bar container inner item items links list menu wrap wrapper"),
        ("footer sidebar", "area bottom container inner links menu nav top widget widgets wrap wrapper"),
        ("breadcrumb breadcrumbs pagination", "container item links list nav wrap wrapper"),
        ("comment comments", "area box container form list respond section thread wrap wrapper"),
        ("cookie cookies consent", "alert banner bar box consent dialog message modal notice overlay popup wall"),
        ("newsletter subscribe", "banner block box form modal popup signup subscribe widget"),
        ("related", "articles content entries items links news posts products reading stories topics"),
        ("share sharing social", "bar box button buttons icons links list media menu share sharing tools widget"),
        ("promo sponsored sponsor", "banner block box content links post posts"),
        ("modal popup", "backdrop body container content dialog overlay window wrapper"),
        ("widget", "area container wrap wrapper"),
    )
    for first in firsts.split()
    for second in seconds.split()
)


def _without_raw(page: str) -> str:
    """The page without comments, scripts and styles; one that never ends goes up to the end."""
    lower = page.lower() if page.isascii() else re.sub("[A-Z]+", lambda m: m[0].lower(), page)
    out, at = [], 0
    opening = re.compile(r"<!--|<(script|style)(?=[\s/>])")
    while found := opening.search(lower, at):
        out.append(page[at : found.start()])
        close = f"</{found[1]}" if found[1] else "-->"
        end = lower.find(close, found.end())
        end = lower.find(">", end) if end >= 0 else -1
        if end < 0:
            return "".join(out)
        at = end + 1
    return "".join([*out, page[at:]])


def _unwanted(name: str, attributes: str, inside: bool) -> bool:
    if name in _NEVER or (name == "header" and not inside):
        return True
    return name not in ("html", "body", "article", "main") and _named_unwanted(attributes)


def _named_unwanted(attributes: str) -> bool:
    """By the tokens of its class, id and role; no other attribute counts, and the first of a name holds."""
    if "=" not in attributes:
        return False
    seen = set()
    for kind, *values in _ATTRIBUTE.findall(attributes):
        kind = kind.lower()
        if kind not in ("class", "id", "role") or kind in seen:
            continue
        seen.add(kind)
        for token in next((v for v in values if v), "").lower().split():
            if token in _ROLES if kind == "role" else token in _CLASSES or re.sub("[-_]+", "-", token) in _COMPOUNDS:
                return True
    return False


def _articles(tags: list[re.Match], names: list[str], close: dict[int, int]) -> list[int]:
    """Where an article or main opens; an article inside another whose own name is unwanted (a comment) isn't counted."""
    found, raw, ends = [], -1, []
    for i, (tag, name) in enumerate(zip(tags, names)):
        if tag[1] or i < raw:
            continue
        if name in _RAW:
            raw = close.get(i, raw)
        elif name in ("article", "main"):
            while ends and ends[-1] < i:
                ends.pop()
            if name == "main" or not ends or not _named_unwanted(tag[3] or ""):
                found.append(i)
            if name == "article" and i in close:
                ends.append(close[i])
    return found


@dataclass
class Line:
    text: str
    plain: int  # its characters outside links
    inside: bool  # whether it is in the marked article
    parent: int  # its container
    paragraph: bool


def page_lines(page: str) -> list[Line]:
    """The lines of a page that hold text, without those of unwanted containers."""
    page = _without_raw(page)
    tags = list(_TAG.finditer(page))
    names = [(t[2] or "").lower() for t in tags]
    close, opened = {}, {}
    for i, (t, name) in enumerate(zip(tags, names)):
        if not t[1] and name:
            opened.setdefault(name, []).append(i)
        elif t[1] and opened.get(name):
            close[opened[name].pop()] = i
    articles = _articles(tags, names, close)
    lines: list[Line] = []
    text: list[str] = []
    around: list[tuple[int, int]] = []  # where the open containers end and begin
    links = depth = plain = 0
    kind = ""

    def holds_article(i: int) -> bool:
        k = bisect_right(articles, i)
        return k < len(articles) and articles[k] < close[i]

    def end_line() -> None:
        nonlocal plain
        joined = " ".join(entities.unescape("".join(text)).split())
        if joined:
            parent = around[-1][1] if around else -1
            lines.append(Line(joined, min(plain, len(joined)), depth > 0, parent, kind in _PARAGRAPHS))
        text.clear()
        plain = 0

    def add(part: str) -> None:
        nonlocal plain
        text.append(part)
        if not links:
            plain += len(part.strip())

    i, at = 0, 0
    while i < len(tags):
        tag, name = tags[i], names[i]
        add(page[at : tag.start()])
        at = tag.end()
        if not tag[1] and i in close and name and _unwanted(name, tag[3] or "", depth > 0) and not holds_article(i):
            end_line()
            i = close[i]
            at = tags[i].end()
        elif name in _BLOCK:
            end_line()
            kind = "" if tag[1] else name
            while around and around[-1][0] <= i:
                around.pop()
            if name in _CONTAINERS and i in close:
                around.append((close[i], i))
            if name in ("article", "main") and (tag[1] or i in close):
                depth = max(0, depth - 1) if tag[1] else depth + 1
        elif name == "br":
            text.append(" ")
        elif name == "a":
            links = max(0, links - 1) if tag[1] else links + (i in close)
        i += 1
    add(page[at:])
    end_line()
    return lines


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The lines of the main text, two line breaks between them; empty if there are none."""
    lines = page_lines(page or "")
    kept = [line for line in lines if line.inside]
    if not kept:
        upto = [0, *accumulate(line.plain for line in lines)]
        sums = [upto[min(i + window, len(lines))] - upto[i] for i in range(len(lines))]
        peak = max(sums, default=0)
        least = surge if peak > surge else max(1, peak // 2)
        begins = [i for i, line in enumerate(lines) if line.plain and sums[i] > least]
        first = begins[0] if begins else len(lines)
        dive = next((i for i in range(begins[-1], len(lines)) if not sums[i]), len(lines)) if begins else 0
        parents = {line.parent for line in lines[first:dive] if line.plain}
        kept = [
            line
            for i, line in enumerate(lines)
            if first <= i < dive or line.parent in parents and (line.plain or line.paragraph)
        ]
    return "\n\n".join(line.text for line in kept)


def extract_text(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns with the ``text`` of each page and ``n_chars``, its code points.

    A null or empty page, or one without main text, has an empty text. Repeated pages are treated
    each; other columns aren't read; an empty table gives an empty result. No shuffle.
    """

    rows = pages.select(*[F.col(c) for c in keep], F.col(html).alias("__html"))
    found = add_columns(rows, ["__html"], {"text": "string"}, lambda raw: [list(map(main_text, raw))], ["__html"])
    return found.withColumn("n_chars", F.length("text").cast("long"))
