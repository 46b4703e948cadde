"""Main text of web pages by paths that the pages of a host agree on.

Every page is parsed into containers (article, main, section, div, table cell, the page
itself) and blocks of text; what stands in menus, forms, adverts, comments and the like is
no block. A page scores its containers by the text near below them and votes for the path of
its best one: tags and classes from the top, digits made one sign. Spark adds the votes of a
host; its winning paths, most votes first, go back to its pages, and each page takes all
containers on the first of them that it has, or its own best where it has none.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import batches, pin

#: A path wins with so many per cent of its host's votes.
SHARE = 2
_BATCH = 500
_TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'=/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_DIGITS = re.compile(r"\d+")
HOST = r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
#: Never main text.
OUT = frozenset("aside audio button canvas dialog footer form head iframe map menu nav noscript object select svg template video".split())
CONTAINER = frozenset("article body center main section div td".split())
BLOCK = CONTAINER | frozenset("address blockquote caption dd details dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header html legend li ol p pre summary table tbody tfoot th thead tr ul".split()) | OUT
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an opening tag ends, and what that does not reach through.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"}), "a": ({"a"}, BLOCK)}
_P = ({"p"}, BLOCK - {"p"})
#: Words in a class, id or role that mark what is around an article.
AROUND = re.compile(
    r"ad|ads|adbox|adsense|adslot|advert\w*|alert|banner|breadcrumbs?|comment\w*|complementary|consent|contentinfo|cookies?|copyright|dialog|disqus|footer|gdpr|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?"
    r"|pager|pagination|popup|promo\w*|recommend\w*|related|replies|search|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|subscription|toolbar|widgets?"
)
#: Classes that only tell how the page is laid out.
LAYOUT = re.compile(r"(?:has|is|no|with)[-_]", re.I)
ARTICLE = re.compile(r"article|content|entry|post|story|text")
#: How much more a container counts than a div.
WEIGHT = {"article": 2.5, "main": 1.5}


@dataclass
class Page:
    """Containers (parent, path, weight; the first is the page itself) and blocks (container, text, characters in links)."""

    parents: list[int] = field(default_factory=lambda: [-1])
    paths: list[str] = field(default_factory=lambda: [""])
    weights: list[float] = field(default_factory=lambda: [1.0])
    blocks: list[tuple[int, str, int]] = field(default_factory=list)

    def best(self) -> tuple[str, float] | None:
        """Path and score of the best container: text counts by half for each container between, links against it."""
        score = [0.0] * len(self.parents)
        for c, text, linked in self.blocks:
            value = max(0.0, len(text) - 3.0 * linked)
            while c >= 0 and value >= 0.01:
                score[c] += value
                value, c = value / 2, self.parents[c]
        score = [s * w for s, w in zip(score, self.weights, strict=True)]
        top = max(range(len(score)), key=lambda i: (score[i], -i))
        return (self.paths[top], score[top]) if score[top] > 0 else None

    def text(self, path: str) -> str:
        """The blocks inside all containers of that path, joined by spaces."""
        inside: list[bool] = []
        for up, own in zip(self.parents, self.paths, strict=True):
            inside.append(own == path or (up >= 0 and inside[up]))
        return " ".join(t for c, t, _ in self.blocks if inside[c])


def parse(source: str) -> Page:
    page = Page()
    # open elements: tag, container, level (0: text; 1: headings only; 2: none), whether its end ends a block
    stack: list[tuple[str, int, int, bool]] = [("", 0, 0, True)]
    opened: Counter[str] = Counter()
    buffer: list[str] = []
    linked = pos = 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            raw = "".join(buffer)
            text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            if text:
                page.blocks.append((stack[-1][1], text, min(linked, len(text))))
            buffer.clear()
        linked = 0

    def pop_to(n: int) -> None:
        for tag, _, _, block in reversed(stack[n:]):
            if block:
                flush()
            opened[tag] -= 1
            stack.pop()

    def end(names: set[str] | frozenset[str], walls: set[str] | frozenset[str]) -> None:
        if any(opened[x] for x in names):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in names:
                    pop_to(i)
                    return
                if stack[i][0] in walls:
                    return

    def say(a: int, z: int) -> None:
        nonlocal linked
        level = stack[-1][2]
        if a < z and (level == 0 or level == 1 and any(opened[h] for h in HEADING)):
            buffer.append(source[a:z])
            if opened["a"]:
                linked += z - a

    m = _TAG.search(source)
    while m:
        say(pos, m.start())
        pos = m.end()
        name = (m.group(2) or "").lower()
        if not name:
            pass
        elif name == "br" or name == "hr":
            buffer.append(" ")
        elif m.group(1):
            if opened[name]:
                end({name}, () if name in BLOCK else CONTAINER)
            elif name == "p":
                flush()
        elif name not in VOID:
            if name in ENDS:
                end(*ENDS[name])
            if name in BLOCK:
                end(*_P)
                flush()
            _, container, level, _ = stack[-1]
            marks, path = _marks(m.group(3))
            level = max(level, _level(name, marks, opened["article"] > 0))
            if name in CONTAINER and name != "body":
                page.parents.append(container)
                page.paths.append(f"{page.paths[container]}/{name}{path}")
                page.weights.append(WEIGHT.get(name, 1.25 if any(ARTICLE.fullmatch(w) for w in marks) else 1.0))
                container = len(page.parents) - 1
            if name in RAW:
                close = re.compile(f"</{name}(?=[\\s/>])[^>]*(?:>|\\Z)", re.I).search(source, pos)
                pos = close.end() if close else len(source)
            else:
                stack.append((name, container, level, name in BLOCK))
                opened[name] += 1
        m = _TAG.search(source, pos)
    say(pos, len(source))
    pop_to(1)
    flush()
    return page


def _marks(attributes: str) -> tuple[list[str], str]:
    """The words of class, id and role, and the classes as a step of a path."""
    if not attributes or "=" not in attributes:
        return [], ""
    names: list[str] = []
    classes: set[str] = set()
    for key, *values in _ATTRIBUTE.findall(attributes):
        if key.lower() not in ("class", "id", "role"):
            continue
        own = "".join(values).split()
        names += [x for x in own if not LAYOUT.match(x)]
        if key.lower() == "class":
            classes.update(_DIGITS.sub("#", x.lower()) for x in own)
    return [w.lower() for x in names for w in _WORD.findall(x)], "".join("." + c for c in sorted(classes))


def _level(name: str, marks: list[str], in_article: bool) -> int:
    if name in OUT:
        return 2
    if name in ("html", "body", "main", "article") or name in HEADING:
        return 0
    if any(AROUND.fullmatch(w) for w in marks):
        return 2
    if name == "header" or "header" in marks:
        return 1 if in_article else 2
    return 0


def winning_paths(pages: DataFrame, share: int = SHARE) -> DataFrame:
    """host, paths: the paths with ``share`` per cent of the votes of ``pages(host, html)``, most votes first, ties by score, then path."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            votes: dict[tuple[str, str], list[int]] = {}
            for host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if best := parse(source).best():
                    at = votes.setdefault((host, best[0]), [0, 0])
                    at[0] += 1
                    at[1] += round(best[1])
            rows = [(h, p, n, s) for (h, p), (n, s) in votes.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], ["host", "path", "votes", "score"])

    batches(pages.sparkSession, _BATCH)
    votes = pages.mapInArrow(run, "host string, path string, votes long, score long").groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("score").alias("score"))
    fit = votes.withColumn("all", F.sum("votes").over(Window.partitionBy("host"))).filter(100 * F.col("votes") >= share * F.col("all"))
    ranked = fit.groupBy("host").agg(F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), (-F.col("score")).alias("s"), "path"))).alias("paths"))
    return ranked.select("host", F.transform("paths", lambda x: x.path).alias("paths"))


def main_text(pages: DataFrame, share: int = SHARE) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars, path (the one that gave the text).

    The text is that of the article without menus, headers, footers, sidebars, notices,
    adverts, forms, scripts, styles and comments; a heading in the header of an article
    stays. Character references are decoded, white space (as Unicode has it) in a block
    becomes one space, and blocks are joined in page order by one space.

    Null or empty html: empty text, path null. Null url, or one without host: the pages of no
    host vote together. Repeated rows vote again and are all returned. An empty table gives
    no rows; other columns are ignored.
    """
    own = pages.select(F.col("page_id"), F.col("url"), F.coalesce("html", F.lit("")).alias("html"), F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), HOST, 1).alias("host"))
    # written, so that Spark knows its size: small enough it is sent to the pages, else they meet by host
    won = pin(winning_paths(own.select("host", "html"), share), "paths")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts, used = [], []
            for source, paths in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                page = parse(source)
                have = set(page.paths)
                best = page.best()
                for path in [p for p in paths or () if p in have] + ([best[0]] if best else []) + [""]:
                    text = page.text(path)
                    if text:
                        break
                texts.append(text)
                used.append(path if text else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(used, pa.string())], ["page_id", "url", "text", "n_chars", "path"])

    batches(pages.sparkSession, _BATCH)
    both = own.join(won, "host", "left").select("page_id", "url", "html", "paths")
    kind = dict(both.dtypes)["page_id"]
    return both.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, path string")
