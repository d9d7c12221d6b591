"""Main text of web pages by two-pass block rules.

A page is cut into blocks at its block elements.  Regions that are never main text
(navigation, page headers and footers, sidebars, notices, adverts, forms, comments,
hidden parts) are decided against by their marks.  First pass: every other block is
decided by its link density, its length and its stop-word density.  Short blocks, and
longer ones that do not read like text, stay ambiguous; outside of an article, long blocks
that do not read like text are decided against.  Second pass: an ambiguous block inherits
the label of its nearest decided neighbours of the same region (inside or outside of the
article element).

Stop words are known for four languages.  What they cannot judge is never dropped for
lack of them: a text mostly in letters beyond the Latin script, or one of two sentences or
more, reads like text as well.

Nulls, ties and the like
    A null or empty page has an empty text, and so has one without any block of main
    text.  Unclosed and stray tags are tolerated; an unclosed script or style hides
    the rest, and an ``article`` or ``main`` ends whatever unclosed region it stands
    in.  A head ends where text or an element of the body begins.  An ``article`` inside a
    closed navigation, sidebar or the like belongs to that region (teaser cards), unless
    the page leaves elements of that name unclosed or has no other main text.  Where an
    ``article`` or ``main`` is left, text outside of it is no main text, unless it is the
    longer by far: then the articles are teasers of a page whose text stands elsewhere.  If
    the two nearest neighbours differ, the nearer one counts; at equal
    distance a block inside the article is kept and one outside is not.  Without
    decided neighbours a block inside the article is kept; outside, where the page
    has no article, it is kept if it reads like text.  Rows are independent, so
    repeated rows give equal results; extra columns are carried along.  An empty
    table gives an empty result.
"""

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_LINK_DENSITY = 0.33
SHORT_CHARS = 80
LONG_CHARS = 200
LOW_STOP, HIGH_STOP = 0.1, 0.25
# Decided text outside of the articles that makes them teasers: characters, and times their text.
TEASER_CHARS, TEASER_TIMES = 400, 3

# Elements of HTML, by what they mean for the main text.
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p
    pre section summary table tbody td tfoot th thead title tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD_CONTENT = frozenset("html head base basefont bgsound link meta".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math".split())
NEVER = frozenset(
    "nav footer aside form menu dialog button select head object canvas audio video applet fieldset".split()
)
CLOSES = {
    "p": ("p",),
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr",),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
}
SCOPES = frozenset("article main section div table ul ol dl blockquote nav aside footer header form body".split())
ROLES = frozenset(
    "navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split()
)
MARKS = frozenset(
    """nav navbar navigation menu sidebar sidebars footer masthead ad ads advert adverts advertisement advertising
    adsbygoogle adslot adbox adunit adblock adwrapper banner sponsor sponsored promo promotion cookie cookies consent
    gdpr notice notices alert popup modal overlay
    share sharing social related recommended recommendations comment comments reply replies respond disqus
    discussion breadcrumb breadcrumbs pagination pager newsletter subscribe subscription signup login toolbar
    widget widgets copyright skip""".split()
)
COMMENT_MARKS = frozenset("comment comments reply replies respond disqus discussion".split())
# Words of class names that tell of a region elsewhere ("has-sidebar"), or of a state ("comments-enabled").
ABOUT_MARKS = frozenset("has have with without no show hide is".split())
STATE_MARKS = frozenset("enabled disabled open closed free".split())
STOP_WORDS = frozenset(
    """the a an and or but of to in on at for with by from as is are was were be been it its this that these those
    he she they we you i his her their our your not have has had will would can could there which who what when
    der die das den dem des ein eine einen einem einer und oder aber von zu im am auf für mit aus als ist sind war
    waren sein es er sie wir ihr ich nicht auch sich wie bei nach haben hat wird werden dass durch
    le la les un une des du de et ou mais à au aux en dans sur pour avec par ce cette ces il elle ils elles nous
    vous je son sa ses leur est sont était être ne pas que qui se plus comme
    el los las una unos unas y o pero del al con por para sin su sus lo se es son fue ser no como más que está
    este esta""".split()
)

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*)((?:[^'">]|"[^"]*"|'[^']*')*+)>"""
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*)([^>]*)>""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][\w:.-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_WORD = re.compile(r"\w+")
_SENTENCE_END = re.compile(r"""[.!?\u2026\u061f\u06d4\u0964][)"'\u00bb\u201d]*(?:\s|\Z)|[\u3002\uff01\uff1f]""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Block:
    __slots__ = ("pieces", "links", "banned", "inside", "breaks", "region", "card")

    def __init__(self, banned, inside, region):
        self.pieces, self.links, self.banned, self.inside, self.breaks = [], 0, banned, inside, 0
        self.region, self.card = region, False


def _marks(tag: str, raw: str) -> tuple:
    """(never main text, comment) as the attributes of an element tell."""
    if not raw or "=" not in raw and "hidden" not in raw:
        return False, False
    names = {}
    for key, value in _ATTRIBUTE.findall(raw):
        names.setdefault(key.lower(), html.unescape(value.strip("\"'")))
    if "hidden" in names or names.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(names.get("style", "")):
        return tag not in ("html", "body"), False
    if names.get("role", "").lower() in ROLES:
        return True, False
    tokens = [[p.lower() for p in _NAME_PARTS.findall(t)] for k in ("class", "id") for t in names.get(k, "").split()]
    found = set().union(*map(_marks_of_name, tokens))
    comment = bool(found & COMMENT_MARKS)
    if tag in ("html", "body", "main") or tag == "article" and not comment:
        return False, False
    return bool(found), comment


def _marks_of_name(parts: list) -> set:
    """Marks that a class name or id starts or ends with, as in sidebar-content and main-nav."""
    if not parts or parts[0] in ABOUT_MARKS or len(parts) == 2 and parts[1] in STATE_MARKS:
        return set()
    ends = {parts[0]}
    if len(parts) < 2 or parts[-2] not in ABOUT_MARKS:
        ends.add(parts[-1])
    return ends & MARKS


def blocks_of(page: str) -> list:
    """Blocks of ``page`` in order, with their text, linked characters and region."""
    found, stack = [], []
    banned = inside = comment = False
    link = 0
    # The region that an article stands in, by its place in the stack: name, closed or not.
    region, regions, unclosed = None, {}, set()
    block = _Block(False, False, None)

    def finish():
        nonlocal block
        if block.pieces:
            found.append(block)
        block = _Block(banned, inside, region)

    def add(text):
        if not text:
            return
        text = html.unescape(text) if "&" in text else text
        words = text.split()
        if words:
            block.breaks = 0
            if link:
                block.links += sum(map(len, words))
        block.pieces.append(text)

    def close_to(at, ended=False):
        nonlocal banned, inside, comment, link, region
        unclosed.update(e[0] for e in stack[at + ended :])
        for i in [i for i in regions if i >= at]:
            regions.pop(i)[1] = ended and i == at
        blocks = any(e[0] in BLOCK for e in stack[at:])
        _, banned, inside, comment, link, region = stack[at]
        del stack[at:]
        if blocks:
            finish()

    def end_head():
        if stack and stack[-1][0] == "head":
            close_to(len(stack) - 1)

    at, size = 0, len(page)
    lower = None
    while at < size:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else size
        if stack and stack[-1][0] == "head" and page[at:stop].strip():
            end_head()
        add(page[at:stop])
        if not m:
            break
        at = m.end()
        tag = m.group(2) or m.group(5)
        if not tag:
            continue
        ending = m.group(1) or m.group(4)
        raw = m.group(3) if m.group(2) else m.group(6)
        tag = tag.lower()
        if ending:
            if tag == "br" or tag in VOID:
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close_to(i, ended=True)
                    break
                # An inline end tag does not close blocks around it.
                if tag not in BLOCK and stack[i][0] in BLOCK:
                    break
            continue
        if tag in RAW:
            if tag in BLOCK:
                finish()
            if not raw.rstrip().endswith("/"):
                if lower is None:
                    lower = page.lower() if len(page.lower()) == size else page
                end = lower.find("</" + tag, at)
                if end < 0:
                    if tag in ("script", "style", "textarea", "title"):
                        break
                    continue
                stop = page.find(">", end)
                at = size if stop < 0 else stop + 1
            continue
        if tag not in HEAD_CONTENT:
            end_head()
        if tag == "br":
            block.breaks += 1
            if block.breaks > 1:
                finish()
            else:
                block.pieces.append(" ")
            continue
        if tag in CLOSES:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in CLOSES[tag]:
                    close_to(i)
                    break
                if stack[i][0] in SCOPES or tag in ("td", "th", "tr") and stack[i][0] == "table":
                    break
        elif tag in BLOCK:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    close_to(i)
                    break
                if stack[i][0] in SCOPES:
                    break
        block_follows = tag in BLOCK
        if tag in VOID:
            if block_follows:
                finish()
            continue
        stack.append((tag, banned, inside, comment, link, region))
        marked, is_comment = _marks(tag, raw)
        comment = comment or is_comment
        if tag in ("article", "main") and not comment:
            if tag == "main":
                region = None
            elif banned:
                # The element that decided against what stands here.
                at_region = next(i for i in range(len(stack) - 1, -1, -1) if not stack[i][1])
                region = regions.setdefault(at_region, [stack[at_region][0], False])
            banned, inside = marked, True
        elif tag in NEVER or marked or comment or tag == "header" and not inside:
            banned = True
        if tag == "a":
            link += 1
        if block_follows:
            finish()
        elif banned != block.banned:
            finish()  # an inline element that is no main text
    finish()
    unclosed.update(e[0] for e in stack)
    for b in found:
        b.card = b.region is not None and b.region[1] and b.region[0] not in unclosed
    return found


def _labels(blocks: list) -> list:
    """First pass: True, False, or None where a block is ambiguous."""
    out = []
    for text, links, banned, inside in blocks:
        size = len(text)
        if banned or links and links / len(text.replace(" ", "")) > MAX_LINK_DENSITY:
            out.append(False)
        elif size < SHORT_CHARS:
            out.append(None)
        elif _reads_like_text(text):
            out.append(True)
        else:
            out.append(None if inside or size < LONG_CHARS else False)
    return out


def _stop_density(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(len(words), 1)


def _reads_like_text(text: str) -> bool:
    stop = _stop_density(text)
    if stop >= HIGH_STOP:
        return True
    if len(text) < LONG_CHARS:
        return False
    return stop >= LOW_STOP or _beyond_lists(text, 2)


def _beyond_lists(text: str, sentences: int) -> bool:
    """Whether stop words say nothing of a text, but its script or its sentences do."""
    letters = sum(c.isalpha() for c in text)
    if 2 * sum(c.isalpha() and c > "\u024f" for c in text) > letters:
        return True
    return len(_SENTENCE_END.findall(text)) >= sentences


def main_text(page: str | None) -> str:
    if not page:
        return ""
    blocks = []
    for b in blocks_of(page):
        text = " ".join("".join(b.pieces).split())
        if text:
            blocks.append((text, b.links, b.banned, b.inside, b.card))
    kept = _kept([(text, links, banned or card, inside and not card) for text, links, banned, inside, card in blocks])
    return kept or _kept([b[:4] for b in blocks])


def _kept(blocks: list) -> str:
    labels = _labels(blocks)
    has_article = any(inside for _, _, _, inside in blocks)
    if has_article:
        elsewhere = sum(len(b[0]) for b, good in zip(blocks, labels) if good and not b[3])
        within = sum(len(b[0]) for b in blocks if b[3] and not b[2])
        if elsewhere >= TEASER_CHARS and elsewhere > TEASER_TIMES * within:
            return _kept([(text, links, banned or inside, False) for text, links, banned, inside in blocks])
    final = list(labels)
    for inside in (True, False):
        # What stands in a marked region says nothing about the text around it.
        here = [i for i, b in enumerate(blocks) if b[3] == inside and not b[2]]
        before, last = {}, None
        for at, i in enumerate(here):
            before[i] = last
            if labels[i] is not None:
                last = at
        after, last = {}, None
        for at in range(len(here) - 1, -1, -1):
            after[here[at]] = last
            if labels[here[at]] is not None:
                last = at
        for at, i in enumerate(here):
            if labels[i] is None:
                near = [(abs(n - at), labels[here[n]]) for n in (before[i], after[i]) if n is not None]
                final[i] = _inherited(near, inside, has_article, blocks[i][0])
    # Text outside of an existing article is not part of it.
    return "\n".join(b[0] for b, good in zip(blocks, final) if good and (b[3] or not has_article))


def _inherited(near: list, inside: bool, has_article: bool, text: str) -> bool:
    if not near:
        if inside or has_article:
            return inside
        return _stop_density(text) >= LOW_STOP or _beyond_lists(text, 1)
    if len(near) == 2 and near[0][1] != near[1][1]:
        return inside if near[0][0] == near[1][0] else min(near)[1]
    return near[0][1]


def extract(pages: DataFrame, html_col: str = "html", columns: list | None = None) -> DataFrame:
    """``columns`` (all by default) of ``pages`` with the main text as ``main_text``."""
    names = pages.columns if columns is None else columns
    kept = pages.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_kept"), F.col(html_col).alias("_html"))

    def rows(batches):
        for batch in batches:
            texts = pa.array([main_text(v.as_py()) for v in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["_kept", "_text"])

    out = kept.mapInArrow(rows, T.StructType([kept.schema["_kept"]]).add("_text", "string"))
    return out.select("_kept.*", F.col("_text").alias("main_text"))
