"""Main text of web pages by maximum-scoring subsequence: words score positive, tags negative by learned weights."""

from __future__ import annotations

import bisect
import html as entities
import itertools
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from estuary.llm.common import hash_sample, keyed_texts, slices

MAX_LABELLED = 2000
#: What a tag costs, in words, that never occurs inside labelled content.
SCALE = 64.0
#: Cost share of a tag that no labelled page has, by its kind, and how many sightings that guess weighs.
PRIOR, TEXT_PRIOR, INLINE_PRIOR, PRIOR_WEIGHT = 0.01, 0.002, 0.0, 2.0
#: Of the articles of a page, those with so large a share of the largest one's words are its text; others are teasers.
TEASER = 0.2
#: An advert inside an article has so large a share of its words at most.
ADVERT_SHARE = 0.25

# HTML element names.
RAW = frozenset("script style textarea title".split())
SKIPPED = frozenset("head script style title noscript template svg iframe object canvas audio video nav footer header aside form button select menu dialog".split())
BLOCKS = frozenset("address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Of the skipped, those that may also hold the whole page or its article.
WRAPPERS = frozenset("nav footer header aside form menu dialog noscript".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - {"html", "body"}
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words of a class, id or role that mark what is not the article.
HINTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent notice notices alert popup modal nav navigation navbar menu breadcrumb breadcrumbs sidebar aside footer masthead comment comments discussion disqus reply replies respond share sharing social related newsletter subscribe signup search login form contentinfo complementary dialog".split())
#: Hints that hold however large the element is.
COMMENTS = frozenset("comment comments discussion disqus reply replies respond".split())
#: The other hints that hold inside an article.
ADVERTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo banner".split())
#: Words that a name may have beside a hint: related-posts is one, related-work is not.
PARTS = frozenset("action actions area article articles bar block body bottom box button buttons cards center container content cta feed footer form global group header holder icon icons inner item items left link links list main media module panel policy post posts primary region right row rss section secondary site slot small space top toggle text thread up unit user widget widgets wrap wrapper zone".split())
# Elements of running text, and those inside a line.
TEXTUAL = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 li ol ul dl dt dd table caption colgroup tbody thead tfoot tr td th figure figcaption details summary".split())
INLINE = frozenset("a abbr b bdi bdo br cite code data del dfn em font i img ins kbd mark math q ruby s samp small span strong sub sup time tt u var wbr".split())
#: After these a class tells what the page has, not what the element is: has-sidebar, no-comments.
ABOUT = frozenset("has have no not non with without hide hides show shows".split())
#: A class that ends with one of these tells a state: comments-open, ad-free.
STATES = frozenset("open closed enabled disabled on off free allowed count left right top bottom".split())
LABELLED = ("article", "main")

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^<>]*+)>")
_MARK = re.compile(r"class|id|role|aria-hidden|style|hidden", re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++)))?")
_NAMES = re.compile(r"[a-z]+")


def hints(value: str) -> set[str]:
    """The words of a class, id or role that tell what its element is: token by token, none after a word of ABOUT, none of a state.

    A token counts if all its words are hints or PARTS, so one that only has a hint in it, as notice-period, does not.
    """
    out: set[str] = set()
    for token in value.split():
        words = _NAMES.findall(token)
        if words and words[-1] in STATES and len(words) > 1:
            continue
        named = set(itertools.takewhile(lambda word: word not in ABOUT, words))
        if named <= HINTS | PARTS:
            out |= named & HINTS
    return out


def unwanted(name: str, attributes: str) -> str:
    """Why an element is no part of an article: 'never' by its name or because it is hidden, 'comments', 'advert' or 'hint' by class, id or role, 'wrapper' or 'header' by its name, else ''."""
    if name in SKIPPED and name not in WRAPPERS:
        return "never"
    why = "header" if name == "header" else "wrapper" if name in WRAPPERS else ""
    if name in ("body", "html") or not attributes or not _MARK.search(attributes):
        return why
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name not in LABELLED and (key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value)):
            return "never"
        if key in ("class", "id", "role") and (found := hints(value)):
            kind = "comments" if not found.isdisjoint(COMMENTS) else "advert" if not found.isdisjoint(ADVERTS) else "hint"
            why = next(k for k in ("comments", "wrapper", "advert", "hint") if k in (why, kind))
    return why


def parsed(page: str) -> tuple[list[tuple[str, str]], list[tuple[int, int, str, str]]]:
    """All texts (not decoded) and tags of a page in order, and (first, end, name, why) of each element that is unwanted, an article or a main."""
    at, size, text = 0, len(page), []
    events: list[tuple[str, str]] = []
    stack: list[tuple[str, int]] = []
    open_names: Counter[str] = Counter()
    elements: list[list] = []

    def close(end: int) -> None:
        name, i = stack.pop()
        open_names[name] -= 1
        if i >= 0:
            elements[i][1] = end

    while at < size:
        mark = page.find("<", at)
        if mark < 0:
            mark = size
        if mark > at:
            text.append(page[at:mark])
        if mark == size:
            break
        m = _TAG.match(page, mark)
        if not m:
            if page.startswith("<!--", mark):
                end = page.find("-->", mark + 4)
                at = size if end < 0 else end + 3
            elif page[mark + 1 : mark + 2] in ("!", "?"):
                end = page.find(">", mark)
                at = size if end < 0 else end + 1
            else:
                text.append("<")
                at = mark + 1
            continue
        at = m.end()
        closing, name, attributes = (m[1], m[2].lower(), m[3]) if m[2] else (m[4], m[5].lower(), m[6])
        if text:
            events.append(("text", "".join(text)))
            text = []
        if closing:
            if open_names[name]:
                while stack[-1][0] != name:
                    close(len(events))
                events.append(("tag", "/" + name))
                close(len(events))
            continue
        closed = {"p"} if name in CLOSES_P else set()
        closed |= SELF_CLOSING.get(name, set())
        while stack and stack[-1][0] in closed:
            close(len(events))
        why = unwanted(name, attributes)
        events.append(("tag", name))
        if name in EMPTY or attributes.endswith("/"):
            continue
        if why or name in LABELLED:
            elements.append([len(events) - 1, -1, name, why])
        stack.append((name, len(elements) - 1 if why or name in LABELLED else -1))
        open_names[name] += 1
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            events.append(("text", page[at : end.start() if end else size]))
            at = end.start() if end else size
    if text:
        events.append(("text", "".join(text)))
    return events, [(first, len(events) if end < 0 else end, name, why) for first, end, name, why in elements]


def tokens(page: str) -> tuple[list[tuple[str, str]], list[tuple[int, int]]]:
    """What a page holds without unwanted elements, and where in it the articles lie.

    A token is 'tag' with a name ('/' before an end tag) or 'text', decoded. The articles are the page's article
    elements but for teasers (see TEASER), in its main element where one holds most of it, or else that main element.
    An element that is unwanted by a hint stays if it holds the articles, or, on a page with neither and if it is no list
    of comments, over half of the words. Inside an article element only comments, small adverts and elements like <nav>
    go, and its own <header> stays. If nothing but hints and comments is left of a page's words, hints do not count.
    """
    events, elements = parsed(page)
    gone = _covered(len(events), [(first, end) for first, end, name, why in elements if why == "never"])
    before = [0]
    for (kind, value), skip in zip(events, gone, strict=True):
        before.append(before[-1] + (len(value.split()) if kind == "text" and not skip else 0))
    size = lambda x: before[x[1]] - before[x[0]]
    labelled = [(first, end, name) for first, end, name, why in elements if name in LABELLED and not why and not gone[first]]
    mains = outermost([x for x in labelled if x[2] == "main"])
    articles = outermost([x for x in labelled if x[2] == "article"])
    in_main = _covered(len(events), [(x[0], x[1]) for x in mains])
    held = [x for x in articles if in_main[x[0]]]
    if mains and 2 * sum(map(size, held)) < sum(map(size, mains)):
        own = mains
    else:
        own = held or articles
        largest = max(map(size, own), default=0)
        own = [x for x in own if size(x) >= TEASER * largest]
    inside = _covered(len(events), [(x[0], x[1]) for x in own if x[2] == "article"])
    starts = [x[0] for x in own]
    first_own, last_own = min(starts, default=0), max((x[1] for x in own), default=0)
    out = []
    for first, end, name, why in elements:
        if why in ("", "never") or name in LABELLED:
            continue
        if inside[first]:
            around = own[bisect.bisect_right(starts, first) - 1]
            small = before[end] - before[first] <= ADVERT_SHARE * size(around)
            holds = why in ("hint", "header") or why == "advert" and not small
        elif own:
            holds = first < first_own and last_own <= end
        else:
            holds = why != "comments" and 2 * (before[end] - before[first]) > before[-1]
        if not holds:
            out.append((first, end, why))
    unwanted_ = _covered(len(events), [(first, end) for first, end, _ in out])
    if before[-1] and all(before[i] == before[i + 1] or unwanted_[i] for i in range(len(events))):
        unwanted_ = _covered(len(events), [(first, end) for first, end, why in out if why == "comments"])
    left, at = [], [0]
    for (kind, value), never, skip in zip(events, gone, unwanted_, strict=True):
        if not never and not skip:
            left.append((kind, entities.unescape(value) if kind == "text" else value))
        at.append(len(left))
    return left, [(at[first], at[end]) for first, end, _ in own]


def outermost(elements: list[tuple]) -> list[tuple]:
    """Elements that lie in none of the others, in order."""
    out: list[tuple] = []
    for x in sorted(elements, key=lambda x: (x[0], -x[1])):
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


def _covered(n: int, ranges: list[tuple[int, int]]) -> list[bool]:
    """For each of n places, whether a range holds it."""
    step = [0] * (n + 1)
    for first, end in ranges:
        step[first] += 1
        step[end] -= 1
    return [depth > 0 for depth in itertools.accumulate(step[:n])]


def sightings(page: str) -> list[tuple[str, int, int]]:
    """(tag, inside, outside) of a labelled page: counts within its single article or main element; none for other pages."""
    found, _ = tokens(page)
    for name in LABELLED:
        starts = [i for i, t in enumerate(found) if t == ("tag", name)]
        ends = [i for i, t in enumerate(found) if t == ("tag", "/" + name)]
        if len(starts) == len(ends) == 1 and starts[0] < ends[0]:
            counts: dict[str, list[int]] = {}
            for i, (kind, value) in enumerate(found):
                if kind == "tag":
                    counts.setdefault(value, [0, 0])[not starts[0] < i < ends[0]] += 1
            return [(k, *v) for k, v in counts.items()]
    return []


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", max_labelled: int = MAX_LABELLED, scale: float = SCALE) -> dict[str, float]:
    """What each tag costs: scale times its share of sightings outside the labelled content.

    The costs are learned from max_labelled pages at most, those whose ids have the smallest hashes; tags that these do
    not hold have the prior.
    """
    ids = F.broadcast(hash_sample(pages.select(F.col(id_col).alias("key")).where("key is not null").distinct(), "key", max_labelled))
    source = keyed_texts(pages, id_col, html_col).join(ids, F.col("id") == F.col("key")).select("text")

    def count(batches):
        for batch in batches:
            rows = [s for x in batch.column("text").to_pylist() for s in sightings(x)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2))], names=["tag", "inside", "outside"])

    totals = source.mapInArrow(count, "tag string, inside long, outside long").groupBy("tag").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o"))
    rows = totals.collect()  # the tag names of max_labelled pages
    return {r.tag: scale * (r.o + PRIOR * PRIOR_WEIGHT) / (r.i + r.o + PRIOR_WEIGHT) for r in rows}


def prior(tag: str) -> float:
    """The cost share of a tag that no labelled page has: little for elements of running text, none inside a line."""
    name = tag.lstrip("/")
    return INLINE_PRIOR if name in INLINE else TEXT_PRIOR if name in TEXTUAL else PRIOR


def main_text(page: str, weights: dict[str, float], scale: float = SCALE) -> str:
    """The blocks of the best contiguous region, joined by an empty line; white space inside a block becomes one space.

    Where the page marks its articles and the region meets one, the region is all of them, so that neither a costly
    table nor what stands between two of them cuts off the rest.
    """
    found, articles = tokens(page)
    best, best_range, total, first = 0.0, (0, 0), 0.0, 0
    for i, (kind, value) in enumerate(found):
        total += len(value.split()) if kind == "text" else -weights.get(value, scale * prior(value))
        if total <= 0:
            total, first = 0.0, i + 1
        elif total > best:
            best, best_range = total, (first, i + 1)
    regions = [best_range]
    if any(a < best_range[1] and best_range[0] < b for a, b in articles):
        regions = articles
    blocks: list[list[str]] = [[]]
    for kind, value in itertools.chain.from_iterable([*found[a:b], ("tag", "p")] for a, b in regions):
        if kind == "text":
            blocks[-1].append(value)
        elif value.lstrip("/") in BLOCKS:
            blocks.append([])
        elif value == "br":
            blocks[-1].append(" ")
    return "\n\n".join(b for b in (" ".join("".join(x).split()) for x in blocks) if b)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    Null or empty html: empty text. Broken markup is read as far as it goes, very long pages whole, in time linear in
    their length. Of regions with equal scores the first counts, and of those from one start the shortest. Repeated
    rows come back once each. Other columns are ignored, whatever their names. Empty table: no rows.
    """
    weights = fit(pages, id_col, html_col) if weights is None else weights
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField("page_id", source.schema["id"].dataType), T.StructField("url", source.schema["url"].dataType), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def read(batches):
        for whole in batches:
            for batch in slices(whole, limit=16 << 20):
                texts = [main_text(x, weights) for x in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return source.mapInArrow(read, schema)
