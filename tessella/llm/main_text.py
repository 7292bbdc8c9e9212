"""Main text of web pages: flat text blocks and a decision tree.

A page becomes a flat row of text blocks, cut at block-level tags. A block has its words and link
density, those of the blocks before and after, how it is tagged (heading, text element, bare container),
whether it ends like a sentence, and what the elements around it and their names say. None of these
decides: a decision tree, grown here from the small labelled table of pages below, tells main text from
the rest by all of them; the blocks it keeps are joined.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.html import CLOSES_P, HEADINGS, VOID, tokens
from tessella.llm.common import small_batches

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose content is no text of the page.
SILENT = frozenset("script style noscript template svg title iframe object canvas audio video select option textarea button".split())
#: Elements that hold text; others are bare containers.
TEXTUAL = frozenset("p li dd dt td th pre blockquote figcaption caption address summary".split()) | HEADINGS
FRAME_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
MAIN_TAGS = frozenset("article main".split())
FRAME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
#: Parts of class names and ids that hint at the page's frame, and at its main part.
FRAME_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright disclaimer disqus dropdown "
    "foot footer gdpr head header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup privacy promo promoted promotion "
    "recommended related replies reply respond search share sharing sidebar side signup skip social sponsor sponsored subscribe subscription tags teaser toc toolbar topbar widget widgets".split()
)
MAIN_NAMES = frozenset("article body content entry main maincontent post story text".split())
#: First parts of names that say what a container has, not what it is.
ABOUT = frozenset("has is no not with without js".split())
_NAME = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"\S+")

#: What the elements around a block say: nothing, article or main, a name like it, an element of the frame, a name like it.
NEUTRAL, ARTICLE, MAIN_NAME, FRAME, FRAME_NAME = "", "a", "m", "f", "n"
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "in_article", "in_main_name", "in_frame", "in_frame_name", "beside_article", "elsewhere", "heading", "textual", "sentence")
#: Labelled pages, made by hand, one a line, a word for each block in page order: + (main text) or -; what is around it
#: (as above); h heading, t text element, d bare container; words; link density in percent after a slash; a full stop
#: where it ends like a sentence. Fixed values.
LABELLED = """
-ft1/100 -ft2/100 -ft1/100 +ah8 +at60. +at4. +at95. +at2. +at31/5. -ft6.
-fd3/100 -ft2/100 -nd9. +ah11 +at25. +at1 +at140. +at2 +at3. -ft14.
-ft1/100 -nd8. +ah6 +at12. +at40. +ah3 +at70/4. +at5 +at6 +at4 -ft9/30.
-ft2/100 -ft1/100 +ah9 +at80. -ad5 +at66. -ad6/100 +at90. +at7. -nt30. -nt41. -ft5
-ft1/100 +ah4 +at2/100 +at30/40. +at55. -ad4 +at61. +at12 +ah2/100 +at48. -ft3/100
-h3 -ft1/100 +ah7 -at2/100 -at1/100 -at3/100 +at50. +at45. -ad3/100 -ad5/100 -ad4/90 -ft12.
-nd14. -ft1/100 -ft1/100 +ah10 +at5 +at44. +at2. +at18 +at33. -nt26. -nt8. -nt60. -ft7/50
-ft1/100 -ft1/100 -nd7. +ah1. +at1. -ft1
-ft2/100 +ah1 +at2. +at1. +at4 -ft1.
-ft1/100 -nd1 +ah2 +at1 +at3. +at1 -ft2
-ft1/100 +ah3 +at5. +at2. -ft1.
+ah1 +at1
+ah2. +at3. -ft1
-fd1 +ah4. +at4. -nd1 +at5. -ft1
-nd1. +ah5 +at1. +at4. -ft1/100
+ah6 +at50. +at5.
-ft1/100 +ah2 +at44. +at2.
+mh4 +mt60. +mt3.
+h5 +t40. +t6.
-ft1/100 +ah4 +at30. +at9 -ft2/100 -ft1/100
-ft14/100 -ft40/95 -ft22/100 +ah5/20 +at40/20. +at20/20 +at8/22. +at150/18. +at1 +at13/20 -ft80/100
-t20/100 -t14/100 -nd45/100 +t60/15. +t33/20 +t41. -t16/100 -t30/100 -t80/95
-nt13/100 -nt50/95 +ah3 +at5/20. +at2. +at21/15 -fd80/90 -nt40/100
-t1/100 +mh5 +mt40. +mt30. -nd20. -ft4
-ft2/100 -nd8. +mh5 +mt44. +mt72. +mt12 -nt14. -nt27. -nd11. -ft2.
+h5 +t40. +t33. -nd20. -nt30.
-t1/100 +h4 +t60 +t80. -nd12. -nd28. -ft3.
-t2/100 -t1/100 +h4 +t30. +t25 -nt18. -t1/100
-ft1/100 +ah4 +at2/50. +at3/40. +at25. +at1/50 +at9/45. -nd3/50 -ft2/50
-ft1/100. -ft2/100. -ft1/100. -nt3/100. -nd2/100 +ah7. +at20. +at3/20. -ft1/100. -nd1/100. -ft13/100. -fd80/100.
-t1/100. -t2/100. -d3/100. +h7. +t20. +t30/20. -t1/100. -t4/100. -t25/100. -d90/100.
-nt2/100. -ft20/100. +mh7. +mt20. +mt33/10. -ft3/100. -nt8/100. -nt40/100.
-nd13. -nt80 -nd20. -ft3/100. -ft40/100. +ah1. +at2. +at2 -nd1. -nt20. -ft9/100.
-ft3/100 +ad35. +ad80. +ad3. +ad64 -ad5 +ad52. -nd22. -ft20.
-ft1/100 +at9. +at7. +at1. +at3. +at2. +at12. -ft8.
-ft2/100 -ft2/100 +ah5 +at15/60. +at9/80. +at22/50 +at30. -ft4
-ft2/100 +at210. -ft6.
-nd7. +at1. -ft11.
-ft1/100 -nd12. +ah12 +at2. +at3 +at85. +at1. +at2. +at47. -ft16.
-ft1/100 -d20. +ah6 +at44. +at30. -t35. -t50. -ft9.
-d2 -d5. +at44. +at2. -d40. -h3 -t4/100 -t6/100
-t1/100 -t2/100 -t1/100 +h7 +t60. +t45. +t18 +t90/3. -t2/100 -t1/100 -t4
-d1/100 -d2/100 +d48. +d70. +d30 -d1/100 -d3
-t2/100 -t1/100 +h5 +t40 +t52. +t16 +t33 -t1/100 -t2/100
-d3 -d2/100 +h9 +t12. +t33. +h3 +t55. +t9 +t8 +t7 +t40. -d6 -t1/100 -t2/100
-t1/100 -t1/100 -t1/100 +t25 +t60 +t19. -d2/100 -d4
+h6 +t75. +t14. +t22 +t130/2.
+t40. +t35. -h2 -t5/100 -t6/100 -t4/100 -d3
-d1/100 +t110. +t9. +t11. +t85. -h3 -t7/100 -t9/95 -t8/100 -d5/40
-t2 -t1 -t3 -t1/100 +h8 +t36. +t44. +t28 -t2 -t3 -t1
-d4/50 +d60. +d25. +d14 +d44. -d2/50 -d2
+d18 +d40 +d33 +d21.
-t3/100 -t2/100 +t18 +t24. +t16 +t38 -t1/100
+t14. +t12 +t20. +t17
-d2/100 -d5/60 +h4 +d90. +d12/20. +d75/5. -d10/70 -d8/60
-mh3/100 +mh7 +mt50. +mt33 +mt4. +mt61. -md4/100 -md3/100 -ft8.
-ft1/100 +mh5 +md70. +md44/4. -md4 +md51. -nt20. -nt33. -ft5.
-ft2/100 +mt25. +mt3. +mt18 +mt64. -mt2/100 -mt1/100 -nd15.
-ft3/100 -ft2/100 -d3/100 +mh6 +mt9. +mt45. +mh2 +mt80. +mt6 +mt7 -ft12. -fd40.
+nt45. +nt60. +nt38/3. +nh5 +nt70.
-d2/100 -d1/100 +nh4 +nt90. +nt64. +nt75. -t1/100
-nd12. -nd3/100 -nt9/20. -nd15.
-ft40. -ft2/100 -fh3 -ft25. -ft75/5. -fd8 -ft180.
-d1 -d2/100 -d1/100 -d2
-h2 -t6/100 -t5/100 -t7/95 -t4/100
-d3/100 -d2/100 -d4/100 -d5/80 -d2
-fd2 -fd1 -fd6. -d2/100
"""


@dataclass(slots=True)
class Block:
    text: str
    words: int
    links: float
    around: str
    tag: str
    sentence: bool


def _around(name: str, attrs: dict[str, str], inside: str) -> str:
    """What is around the content of an element that opens ``inside``."""
    if name in FRAME_TAGS or attrs.get("role", "").lower() in FRAME_ROLES:
        return FRAME
    if name == "header":
        return inside if inside == ARTICLE else FRAME
    if name in MAIN_TAGS or attrs.get("role", "").lower() == "main":
        return inside if inside in (FRAME, FRAME_NAME) else ARTICLE
    if name in ("html", "body") or not ("class" in attrs or "id" in attrs):
        return inside
    # The first and last part of a name say what it is ("cookie-notice", "site-header"), one in between doesn't ("market-share-report").
    parts = [p for x in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split() if (p := _NAME.findall(x)) and p[0] not in ABOUT]
    if any(p[0] in FRAME_NAMES or p[-1] in FRAME_NAMES for p in parts):
        return FRAME_NAME if inside != FRAME else FRAME
    return MAIN_NAME if inside == NEUTRAL and any(p[0] in MAIN_NAMES or p[-1] in MAIN_NAMES for p in parts) else inside


def blocks(source: str) -> list[Block]:
    """The page's flat text blocks, in order.

    A silent element that is never closed silences up to the next block-level tag, and a nav that is
    never closed ends at the next heading or paragraph.
    """
    out: list[Block] = []
    text: list[str] = []
    linked = 0
    open_: list[tuple[str, str, str]] = []  # name, what is around, and text element of open elements that aren't inline
    link, inside, tag = 0, NEUTRAL, ""
    quiet, deep, loose = "", 0, False
    all_ = list(tokens(source))
    ends = Counter(value for kind, value, _ in all_ if kind == "end" and (value in SILENT or value == "nav"))
    lost: set[int] = set()  # places in open_ of nav elements without an end

    def cut() -> None:
        nonlocal linked
        if text:
            t = _SPACE.sub(" ", "".join(text)).strip()
            text.clear()
            if t:
                n = len(_WORD.findall(t))
                out.append(Block(t, n, min(1.0, linked / n), inside, tag, t[-1] in ".!?…:;\"'»”。！？"))
        linked = 0

    def shut(at: int) -> None:
        nonlocal inside, tag
        del open_[at:]
        lost.difference_update([i for i in lost if i >= at])
        inside, tag = open_[-1][1:] if open_ else (NEUTRAL, "")

    for kind, value, attrs in all_:
        if kind == "end" and value in ends:
            ends[value] -= 1
        if quiet:
            if kind == "start" and loose and value in CLOSES_P:
                quiet = ""
            else:
                if value == quiet and kind != "text":
                    deep += 1 if kind == "start" else -1
                    if not deep:
                        quiet = ""
                continue
        if kind == "text":
            text.append(value)
            if link:
                linked += len(_WORD.findall(value))
        elif kind == "start":
            if value in VOID and value not in ("br", "hr"):
                continue
            if value in SILENT:
                quiet, deep, loose = value, 1, ends[value] < 1
                continue
            if value == "a":
                link = 1
            elif value == "br":
                text.append(" ")
            elif value not in INLINE:
                cut()
                link = 0
                if value in ("hr", "html", "body"):
                    continue
                if lost and (value == "p" or value in HEADINGS):
                    shut(min(lost))
                if value == "p" and open_ and open_[-1][0] == "p":
                    shut(len(open_) - 1)
                if value == "nav" and ends["nav"] < 1:
                    lost.add(len(open_))
                inside = _around(value, attrs, inside)
                tag = value if value in TEXTUAL or value not in ("b", "i") and not tag else tag
                open_.append((value, inside, tag))
            elif "class" in attrs or "id" in attrs or "role" in attrs:
                k = _around(value, attrs, inside)
                if k in (FRAME, FRAME_NAME) and k != inside:
                    cut()
                    inside = k
                    open_.append((value, k, tag))
        else:
            if value == "a":
                link = 0
            at = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == value), None)
            if value in INLINE and at is None:
                continue
            cut()
            if at is not None:
                shut(at)
    cut()
    return out


class Tree:
    """A decision tree by Gini impurity on numeric features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 12):
        self.rule = None
        self.value = int(y.sum() * 2 >= len(y))
        if depth and 0 < y.sum() < len(y):
            best = None
            for f in range(x.shape[1]):
                cuts = np.unique(x[:, f])
                for c in (cuts[1:] + cuts[:-1]) / 2:
                    left = x[:, f] <= c
                    score = sum(n.size * n.mean() * (1 - n.mean()) for n in (y[left], y[~left]))
                    if best is None or score < best[0] - 1e-9:
                        best = (score, f, c)
            if best:
                left = x[:, best[1]] <= best[2]
                self.rule = (best[1], float(best[2]), Tree(x[left], y[left], depth - 1), Tree(x[~left], y[~left], depth - 1))

    def predict(self, row: tuple) -> int:
        t = self
        while t.rule:
            f, c, low, high = t.rule
            t = low if row[f] <= c else high
        return t.value

    def used(self) -> set[str]:
        """Names of the features that the tree asks for."""
        return {FEATURES[self.rule[0]]} | self.rule[2].used() | self.rule[3].used() if self.rule else set()


_SAID = re.compile(r"([+-])([amfn]?)([htd])(\d+)(?:/(\d+))?(\.?)")


def labelled(table: str = LABELLED) -> list[tuple[list[Block], list[int]]]:
    """The blocks of each labelled page, and 1 for main text."""
    pages = []
    for line in table.strip().splitlines():
        said = [_SAID.fullmatch(w).groups() for w in line.split()]
        row = [Block("", int(n), int(k or 0) / 100, around, {"h": "h2", "t": "p", "d": "div"}[tag], bool(stop)) for _, around, tag, n, k, stop in said]
        pages.append((row, [int(x[0] == "+") for x in said]))
    return pages


def grow(table: str = LABELLED) -> Tree:
    x = [f for row, _ in labelled(table) for f in features(row)]
    return Tree(np.array(x, float), np.array([v for _, y in labelled(table) for v in y], float))


@lru_cache(maxsize=1)
def default_tree() -> Tree:
    return grow()


def features(row: list[Block]) -> Iterator[tuple]:
    none = Block("", 0, 0.0, NEUTRAL, "", False)
    marked = any(b.around == ARTICLE for b in row)
    plain = [(b.words * (1 - b.links), b.around not in (FRAME, FRAME_NAME)) for b in row]
    share = 100 * sum(w for w, out in plain if out) / max(1, sum(w for w, _ in plain))  # of the page's words without links, those outside the frame
    for i, b in enumerate(row):
        p, n = row[i - 1] if i else none, row[i + 1] if i + 1 < len(row) else none
        near = (b.words, 100 * b.links, p.words, 100 * p.links, n.words, 100 * n.links)
        yield *near, *(int(b.around == k) for k in (ARTICLE, MAIN_NAME, FRAME, FRAME_NAME)), int(marked and b.around != ARTICLE), share, int(b.tag in HEADINGS), int(b.tag in TEXTUAL), int(b.sentence)


def main_text(source: str, tree: Tree) -> str:
    """Kept blocks, joined by one space."""
    row = blocks(source)
    return " ".join(b.text for b, f in zip(row, features(row), strict=True) if tree.predict(f))


def extract_main_text(pages: DataFrame, html_col: str = "html", tree: Tree | None = None) -> DataFrame:
    """Every column of ``pages``, main_text (empty if there is none) and main_chars, its code points.

    A null page is an empty one, and so is one without text. Pages are taken whole, however long; repeated
    rows give a row each. An empty table gives no rows. Columns of ``pages`` with these names are
    replaced, others pass. No shuffle; a task holds the pages of a batch.
    """
    keep = [c for c in small_batches(pages).columns if c not in ("main_text", "main_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tree or default_tree()
        for b in batches:
            texts = [main_text(x.as_py() or "", t) for x in b.column("__html")]
            yield pa.RecordBatch.from_pydict({n: b.column(n) for n in keep} | {"main_text": pa.array(texts, pa.string()), "main_chars": pa.array([len(x) for x in texts], pa.int64())})

    schema = pages.select(*keep).schema.add("main_text", "string").add("main_chars", "long")
    return pages.select(*keep, F.col(html_col).alias("__html")).mapInArrow(run, schema)


def op8_main_text(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", F.col("main_text").alias("text"), F.col("main_chars").alias("n_chars"))
