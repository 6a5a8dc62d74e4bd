"""A page's blocks of text, and the shape of its tree.

Tags are read as browsers read them where that matters for text: comments, quoted attributes, elements whose content isn't markup, void
elements, and end tags that may be left out. What runs on in a line is no node of the tree; blocks that repeat within their parent share one.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from functools import lru_cache

_TAG = re.compile(
    r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*+)((?>[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|[="'])*+)(>|\Z)|[!?/][^>]*+(?:>|\Z))""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

#: Elements whose content isn't markup; nothing of it is read.
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
#: Elements that have no content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose whole content is no text of the page.
UNSEEN = frozenset("template svg math object canvas audio video select datalist button map".split())
#: Blocks; an open paragraph ends where one of those in ENDS_P begins.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
BLOCKS = ENDS_P | frozenset("html body li dt dd tr td th thead tbody tfoot caption colgroup option optgroup legend label".split()) | UNSEEN
#: Bare ones of these hold running text; all that a parent has of one kind are one node.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tr td th figure figcaption".split())
#: Which open elements an element ends, and beyond which it looks for none.
ENDED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
}
ENDED["thead"] = ENDED["tfoot"] = ENDED["tbody"]
#: An end tag doesn't reach beyond these, but for their own, and for those of a cell's table.
SCOPES = frozenset("table td th caption html template object".split())
CELLS, TABLE_PARTS = frozenset("td th caption".split()), frozenset("table tbody thead tfoot tr".split())
#: Nodes below this level of the tree aren't told from those above them.
MOST_LEVELS = 48

#: Words of class and id names that say what isn't the page's own text.
AD_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adbox adsense banner sponsor sponsored sponsors promo promotion promotions outbrain taboola".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies reply respond responses discussion".split())
NOTICE_WORDS = frozenset("cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay paywall newsletter subscribe subscription signup disclaimer toast".split())
SIDE_WORDS = frozenset("sidebar aside widget widgets related recommended recommendations trending popular teaser teasers share sharing social".split())
FRAME_WORDS = frozenset("nav navbar navigation menu menubar breadcrumb breadcrumbs pager pagination footer header masthead topbar toolbar login search skip copyright".split())
ROLES = {"navigation": "frame", "banner": "frame", "contentinfo": "frame", "search": "frame", "menu": "frame", "menubar": "frame", "complementary": "side", "dialog": "notice", "alertdialog": "notice", "alert": "notice", "form": "frame", "main": "main", "article": "article"}
TAGS = dict.fromkeys(UNSEEN, "hidden") | {"nav": "frame", "footer": "frame", "header": "frame", "form": "frame", "fieldset": "frame", "menu": "frame", "search": "frame", "dialog": "notice", "aside": "side", "main": "main", "article": "article"}
#: Elements whose classes may say that they hold the page's content.
HOLDERS = frozenset("div section center table td".split())
CONTENT_WORDS = frozenset("content article post entry story articlebody postbody maincontent".split())


def _words(name: str) -> list[str]:
    return re.sub(r"([a-z])([A-Z])", r"\1 \2", re.sub(r"[^0-9A-Za-z]+", " ", name)).lower().split()


@lru_cache(1 << 14)
def labelled(tag: str, attributes: str) -> tuple[str, str]:
    """What nodes of a tree are matched by (the tag, classes and id, with all numbers alike), and the part that such a node plays.

    Parts are ``frame``, ``side``, ``notice``, ``ad``, ``comments``, ``hidden``, ``main``, ``article``, ``content`` or none.
    """
    found: dict[str, str] = {}
    for key, *values in _ATTRIBUTE.findall(attributes):
        found.setdefault(key.lower(), "".join(values))
    classes = found.get("class", "").split()
    name = "".join(sorted("." + c for c in classes)) + ("#" + "".join(found["id"].split()) if "id" in found else "")
    style = re.sub(r"\s", "", found.get("style", "").lower())
    words = {w for c in (*classes, found.get("id", "")) for w in _words(c)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
        part = "hidden"
    elif tag in ("html", "body"):
        part = ""
    elif words & COMMENT_WORDS:
        part = "comments"
    elif words & AD_WORDS:
        part = "ad"
    elif tag == "article" and not words & (SIDE_WORDS - {"sidebar", "share", "social"}) or tag == "main":
        part = tag
    elif words & NOTICE_WORDS:
        part = "notice"
    elif words & SIDE_WORDS:
        part = "side"
    elif (role := found.get("role", "").lower()) in ROLES:
        part = ROLES[role]
    elif tag in TAGS:
        part = TAGS[tag]
    elif words & FRAME_WORDS:
        part = "frame"
    else:
        part = "content" if tag in HOLDERS and (words & CONTENT_WORDS or found.get("itemprop", "") == "articleBody") else ""
    return tag + re.sub(r"\d+", "0", name), part


class Page:
    """``labels``, ``parts`` and ``parents`` of the nodes, each after its parent, and ``blocks``: (node, text, characters in links)."""

    def __init__(self) -> None:
        self.labels: list[str] = ["#"]
        self.parts: list[str] = [""]
        self.parents: list[int] = [-1]
        self.blocks: list[tuple[int, str, int]] = []


def read_page(html: str) -> Page:
    """The page's nodes and blocks. No text is left out but what isn't shown as text; what is never closed ends with the page."""
    page, slots = Page(), {}
    # Open elements: tag, node, whether a block, the last child's label, and how often runs of each label have begun.
    stack: list[list] = [["#", 0, True, None, {}]]
    opened: Counter[str] = Counter()
    held: list[str] = []
    linked, links, link_depth = False, 0, 0
    at, size, search = 0, len(html), _TAG.search

    def flush() -> None:
        nonlocal held, links
        text = " ".join("".join(held).split())
        if text:
            page.blocks.append((stack[-1][1], text, min(links, len(text))))
        held, links = [], 0

    def close(upto: int) -> None:
        nonlocal linked
        if any(e[2] for e in stack[upto:]):
            flush()
        opened.subtract(e[0] for e in stack[upto:])
        del stack[upto:]
        if linked and len(stack) < link_depth:
            linked = False

    def enter(tag: str, attributes: str, block: bool) -> None:
        label, part = labelled(tag, attributes.strip())
        top = stack[-1]
        opened[tag] += 1
        if len(stack) > MOST_LEVELS:
            stack.append([tag, top[1], block, None, {}])
            return
        if label in FLOW:
            run = 0
        else:
            runs = top[4]
            if top[3] != label:
                runs[label] = runs.get(label, -1) + 1
            run = runs[label]
        top[3] = label
        key = top[1], label, part, run
        node = slots.get(key)
        if node is None:
            node = slots[key] = len(page.labels)
            page.labels.append(label)
            page.parts.append(part)
            page.parents.append(top[1])
        stack.append([tag, node, block, None, {}])

    while at < size:
        found = search(html, at)
        text = html[at : found.start() if found else size]
        if text:
            if "&" in text:
                text = entities.unescape(text)
            held.append(text)
            if linked:
                links += len(text)
        if not found:
            break
        at = found.end()
        tag = found[2]
        if tag is None or not found[4]:  # a comment or the like; a tag that the page's end cuts off
            continue
        tag = tag.lower()
        if found[1]:
            if tag == "a":
                linked = False
            if not opened[tag]:
                if tag in BLOCKS:
                    flush()
                elif tag == "br":
                    held.append(" ")
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if stack[i][0] in SCOPES and not (tag in TABLE_PARTS and stack[i][0] in CELLS) or stack[i][2] and tag not in BLOCKS:
                    break
            continue
        attributes = found[3]
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            at = end.start() if end else size
            continue
        if tag in ENDS_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][2]:
                    break
        elif tag in ENDED:
            ends, beyond = ENDED[tag]
            last = 0
            if any(opened[x] for x in ends):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in beyond:
                        break
                    if stack[i][0] in ends:
                        last = i
                        if len(ends) <= 2:  # of nested items only the inmost ends
                            break
            if last:
                close(last)
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                held.append(" ")
            continue
        if tag == "a":
            linked, link_depth = True, len(stack)
        if attributes.endswith("/") and tag in ("svg", "math"):  # elsewhere the stroke means nothing
            continue
        if tag in BLOCKS:
            if tag[0] == "h" and tag[1:].isdigit() and stack[-1][0][0] == "h" and stack[-1][0][1:].isdigit():
                close(len(stack) - 1)
            flush()
            if tag in ("html", "body") and opened[tag]:
                continue
            enter(tag, attributes, True)
        elif attributes and not attributes.isspace() and labelled(tag, attributes.strip())[1] not in ("", "content", "main", "article"):
            # A part of a line that is an advert, say: it stands apart.
            flush()
            enter(tag, attributes, True)
        elif opened[tag]:  # within such a part, so that its end is told from this one's
            opened[tag] += 1
            stack.append([tag, stack[-1][1], False, None, {}])
    flush()
    return page
