"""Main text of web pages: nearest-URL page differencing, with the page's own marks of what is an article.

Pages stand in the order of host, URL path and id; a page is paired with that of its two neighbours of the same host
whose path has the longer common beginning (the earlier one in a tie). The text lines (blocks) of both are aligned by
a longest common subsequence, and a line that both share is taken for a part of the site's frame.

Differencing alone deletes an article that a neighbour copies, and leaves menus that differ from page to page. The
page's marks therefore come first where there are any:
- lines in menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts and styles (by element, role,
  or a class or id that names nothing else) are deleted whether they are shared or not; inside an article, ids and
  classes are read on containers alone, so that no heading or paragraph goes by its name, but for classes that name an
  advert;
- a class or id that also has other words (login-flow, menu-prices), or an id of words that are topics as well (search,
  notice), is in doubt: its lines are deleted if the neighbour shares them while the rest of the article is the page's
  own, or if at least half of the text is in links and buttons, and are kept otherwise;
- if an article or main element has text, its other lines are kept, shared or not, and lines outside are deleted;
- if all articles stand in containers whose class or id names a part of the frame, other than comments and related
  pages, these names are not believed and the articles are kept; an article that names would leave empty keeps the
  lines that only names delete;
- if there is no article at all, shared lines are deleted and the rest is kept.

Cases: a null or empty page has the text ""; a null URL is a host and path of its own (empty), as is one that has no
host; a page without neighbours of its host keeps all lines that are not marked; pages of any length are read whole;
null page_ids come first; rows that share host, path and id are ordered by their hash; no rows give no rows; other
columns are ignored; broken markup is read as far as it goes.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import in_small_batches, with_neighbours

#: Elements by their part in a page.
SKIPPED = frozenset("script style noscript template iframe svg canvas object head title select option textarea button audio video".split())
RAW = frozenset("script style title textarea noscript iframe".split())
FRAME = frozenset("nav footer aside form dialog menu".split())
CONTENT = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
FRAME_WORDS = frozenset(
    "nav navbar navigation menu footer sidebar aside ad ads advert adverts advertisement advertising banner promo promoted sponsor sponsored cookie "
    "cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup breadcrumb breadcrumbs share sharing social "
    "related recommended recommendations comment comments disqus reply replies respond widget pagination pager toolbar copyright disclaimer search login".split()
)
#: Of these, words that an article may be about.
TOPICS = frozenset(
    "menu alert notice notices banner promo subscription share sharing social search login copyright disclaimer overlay related recommended "
    "recommendations comment comments reply replies respond sponsor sponsored consent gdpr cookie cookies navigation".split()
)
#: Words that say nothing about what a part holds, beside one that names a part of the frame.
NEUTRAL = frozenset(
    "bar box link links button buttons btn list section container wrapper wrap area block group row col post posts article articles item items form title "
    "top bottom left right main site page global primary secondary content inner outer icons icon slot unit js thread feed panel text big small".split()
)
#: Share of the text in links and buttons from which a part in doubt is taken for a part of the frame.
LINK_SHARE = 0.5
#: Beginnings, ends or middles of longer words that mean the same.
FRAME_STEMS = ("comment", "sidebar", "footer", "cookie", "newsletter", "advert", "navbar", "breadcrumb", "subscri", "sponsor", "pagination", "banner")
FRAME_ENDS = ("nav", "menu")
#: Words after and before which a part of the frame is only spoken of, as in has-sidebar and ad-free.
SPOKEN_OF = frozenset("has with no without after before".split())
SPOKEN_OF_BEFORE = frozenset("free less enabled disabled".split())
#: Of the names above, those of parts that hold articles of others; an article in them is none of the page's own.
OTHERS_WORDS = frozenset("comment comments disqus reply replies respond related recommended recommendations".split())
#: Classes that take a paragraph out of an article.
ADVERT_WORDS = frozenset("ad ads advert adverts advertisement advertising promo promoted sponsor sponsored".split())
HEADER_WORDS = frozenset("header masthead topbar".split())
FRAME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Elements that group others; inside an article only their ids and classes name parts of the frame.
CONTAINERS = frozenset("article aside blockquote center details dialog div dl fieldset figure footer form header main menu nav ol section table tbody ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What may stand in a head; anything else ends it.
IN_HEAD = frozenset("base link meta title style script noscript template".split())
#: Elements whose open one ends where another of them begins.
CLOSED_BY_LIKE = {"p": frozenset({"p"}), "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "tr": frozenset({"tr", "td", "th"})}

# a tag's attributes: quoted and unquoted values whole (an unquoted one may hold quotes), any other character by itself
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|=\s*[^\s\"'>][^\s>]*|[^>])*+)>|[^<]+|<", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=][^\s=>/]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_WORD = re.compile(r"[a-z0-9]+")


@dataclass
class Line:
    text: str
    frame: bool  # in a marked part of the frame
    content: bool  # in an article or main element
    named: bool = False  # in the frame by names alone
    doubtful: bool = False  # in an article, and in the frame only by the name of a container around the article
    doubt: int = 0  # the container in doubt that it stands in, from 1
    linked: int = 0  # characters in links and buttons


@dataclass(frozen=True)
class Marks:
    """What an element and those around it say: part of the frame for certain, by names around the article, by names
    inside it; whether it is in an article, in a link, and in which container in doubt."""

    certain: bool = False
    around: bool = False
    inside: bool = False
    content: bool = False
    link: bool = False
    doubt: int = 0


def _frame_words(words: list[str], in_content: bool) -> list[str]:
    """Those of a name's words that name a part of the frame and are not only spoken of."""
    found = []
    for before, word, after in zip(["", *words], words, [*words[1:], ""], strict=False):
        if before in SPOKEN_OF or after in SPOKEN_OF_BEFORE:
            continue
        if word in FRAME_WORDS or any(x in word for x in FRAME_STEMS) or word.endswith(FRAME_ENDS) or not in_content and (word in HEADER_WORDS or word.endswith("header")):
            found.append(word)
    return found


def _frame_names(value: str, name: str, in_content: bool, is_class: bool) -> tuple[set[str], bool]:
    """The words of a class or id that name a part of the frame for sure, and whether others leave it in doubt.

    Each class is read by itself and is sure if it has no other words but neutral ones; an id of topics alone is in
    doubt. Of an outermost article or main element only the first class counts, and only if it is sure and no topic but
    comments and the like."""
    outermost = name in CONTENT and not in_content
    sure, doubt = set(), False
    for one in value.split()[: 1 if outermost else None]:
        words = _WORD.findall(one)
        found = _frame_words(words, in_content)
        if not found:
            continue
        whole = all(w in found or w in NEUTRAL or w.isdigit() for w in words)
        topics = all(w in TOPICS for w in found)
        if outermost:
            sure |= set(found) if whole and (not topics or any(w in OTHERS_WORDS for w in found)) else set()
        elif whole and (is_class or not topics or any(w in OTHERS_WORDS for w in found)):
            sure |= set(found)
        else:
            doubt = True
    return sure, doubt


def _marks(name: str, attributes: str, outer: Marks, number: int) -> Marks:
    """The marks of an element inside one with the marks `outer`; `number` names it if it is in doubt."""
    certain = name in FRAME or name in SKIPPED or (name == "header" and not outer.content)
    content, names, doubt = name in CONTENT, set(), False
    for key, a, b, c in _ATTRIBUTE.findall(attributes) if attributes and not certain else ():
        key, value = key.lower(), a or b or c
        if key == "role":
            content |= value.lower() in ("main", "article")
            certain |= value.lower() in FRAME_ROLES
        elif key == "hidden":
            certain |= value.lower() != "until-found"
        elif key in ("class", "id"):
            if not outer.content or name in CONTAINERS:
                sure, unsure = _frame_names(value.lower(), name, outer.content, key == "class")
                names, doubt = names | sure, doubt or unsure
            elif key == "class" and name not in HEADINGS:
                names |= ADVERT_WORDS.intersection(value.lower().split())
    if name in ("html", "body"):
        certain, names, doubt = False, set(), False
    certain |= any(w in OTHERS_WORDS or "comment" in w for w in names)
    inner = bool(names) and (content or outer.content)
    certain |= inner and bool(names & ADVERT_WORDS)
    return Marks(
        outer.certain or certain, outer.around or bool(names) and not inner, outer.inside or inner, outer.content or content,
        outer.link or name in ("a", "button"), outer.doubt or (number if doubt and not content else 0),
    )


def lines_of(page: str) -> list[Line]:
    """The page's blocks of text in order, white space joined and character references decoded."""
    out, held = [], []
    stack: list[tuple[str, Marks]] = []
    at, outermost = Marks(), Marks()
    position, raw, linked, opened = 0, None, 0, 0

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            named = (at.inside or at.around) and not at.certain
            out.append(Line(text, at.certain or at.inside or at.around, at.content, named, at.content and at.around and not (at.certain or at.inside), at.doubt, linked))
        linked = 0

    while position < len(page):
        found = _TOKEN.match(page, position)
        whole, position = found[0], found.end()
        if found[2] is None:
            if whole[:2] == "<!" or whole[:2] == "<?":
                continue
            held.append(entities.unescape(whole))
            linked += len(whole) if at.link else 0
            continue
        name = found[2].lower()
        if found[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is None:
                if name in BLOCKS:
                    close()
                continue
            if any(s[0] in BLOCKS or s[0] in SKIPPED for s in stack[depth:]):
                close()
            del stack[depth:]
        else:
            if name in BLOCKS or name in SKIPPED:
                close()
            if stack and stack[-1][0] == "head" and name not in IN_HEAD:
                stack.pop()  # its end tag may be left out
            if name == "br":
                held.append(" ")
            if name in VOID or found[3].rstrip().endswith("/") and name not in BLOCKS:
                continue
            if name in CLOSED_BY_LIKE:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in CLOSED_BY_LIKE[name]:
                        del stack[i:]
                        break
                    if stack[i][0] in BLOCKS:
                        break
            opened += 1
            stack.append((name, _marks(name, found[3], stack[-1][1] if stack else outermost, opened)))
            if name in RAW:
                raw = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(page, position)
                position = raw.start() if raw else len(page)
        at = stack[-1][1] if stack else outermost
    close()
    return out


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """The places in a of a longest common subsequence of a and b."""
    places = defaultdict(list)
    for j, line in enumerate(b):
        places[line].append(j)
    ends: list[int] = []  # least last place in b of a common subsequence of each length
    last: list[int] = []  # the step that ends it
    steps: list[tuple[int, int]] = []  # place in a, step before
    for i, line in enumerate(a):
        for j in reversed(places.get(line, ())):
            k = bisect_left(ends, j)
            steps.append((i, last[k - 1] if k else -1))
            if k == len(ends):
                ends.append(j)
                last.append(len(steps) - 1)
            else:
                ends[k], last[k] = j, len(steps) - 1
    found, step = set(), last[-1] if last else -1
    while step >= 0:
        found.add(steps[step][0])
        step = steps[step][1]
    return found


def settled(lines: list[Line], shared: set[int]) -> list[Line]:
    """The lines after the containers in doubt are judged by what the neighbour shares and by their links."""
    if not any(x.doubt for x in lines):
        return lines
    plain = [i for i, x in enumerate(lines) if x.content and not x.frame and not x.doubt]
    # a neighbour that has most of the article too is a copy, and what it shares is no sign
    copied = 2 * sum(i in shared for i in plain) > len(plain)
    size, linked = defaultdict(int), defaultdict(int)
    for x in lines:
        size[x.doubt] += len(x.text)
        linked[x.doubt] += x.linked
    out = []
    for i, x in enumerate(lines):
        goes = bool(x.doubt) and (linked[x.doubt] >= LINK_SHARE * size[x.doubt] or i in shared and not copied)
        out.append(replace(x, frame=True, named=True) if goes and not x.frame else x)
    return out


def main_text(lines: list[Line], other: list[Line] | None) -> str:
    """The page's main text, given its lines and those of the page that it is paired with."""
    shared = shared_lines([x.text for x in lines], [x.text for x in other]) if other else set()
    lines = settled(lines, shared)
    kept = [x.text for x in lines if x.content and not x.frame] or [x.text for x in lines if x.doubtful] or [x.text for x in lines if x.content and x.named]
    return " ".join(kept or [x.text for i, x in enumerate(lines) if not x.frame and i not in shared])


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


EXTRACTED = "page_id long, url string, text string, n_chars long"


def extracted(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, the main text and its number of code points."""
    rows = in_small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    address = F.coalesce("url", F.lit(""))
    rows = rows.withColumn("host", F.lower(F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)))
    rows = rows.withColumn("path", F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))
    number = F.when(F.col("page_id").isNull(), "").otherwise(F.lpad(F.hex(F.col("page_id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    rows = rows.withColumn("key", F.concat_ws("\x01", "host", "path", number)).withColumn("tie", F.xxhash64("html"))

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, before, own = None, None, None
        done: list[tuple] = []

        def settle(following) -> None:
            """Writes the row that waits, now that both its neighbours are known."""
            near = [x for x in (before, following) if x is not None and x[2] == own[2]]
            best = max(near, key=lambda x: _common(x[3], own[3]), default=None)
            text = main_text(own[4], best[4] if best else None)
            done.append((own[0], own[1], text, len(text)))

        for frame in frames:
            for page_id, url, page, host, path, in_block, role in zip(frame["page_id"], frame["url"], frame["html"], frame["host"], frame["path"], frame["__ev_block"], frame["__ev_role"], strict=True):
                if in_block != block:
                    if own is not None:
                        settle(None)
                    block, before, own = in_block, None, None
                row = (None if pd.isna(page_id) else int(page_id), None if pd.isna(url) else url, host, path, lines_of(page))
                if role < 0:
                    before = row
                elif role > 0:
                    if own is not None:
                        settle(row)
                        own = None
                else:
                    if own is not None:
                        settle(row)
                        before = own
                    own = row
            if done:
                yield _frame(done)
                done = []
        if own is not None:
            settle(None)
            yield _frame(done)

    return with_neighbours(rows, "key", F.octet_length("html"), extract, EXTRACTED, ties=["tie"])


def _frame(done: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(done, columns=["page_id", "url", "text", "n_chars"])
    frame["page_id"] = frame["page_id"].astype("Int64")
    return frame
