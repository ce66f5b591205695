"""Main text of web pages: what a site repeats on many pages is its template, not its text."""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared
from .url_filter import host_and_path

# Element names (fixed values of the HTML standard).
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp noembed noframes iframe".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul video audio noscript template button".split())
CLOSES_P = BLOCK - set("td th tr tbody thead tfoot option optgroup legend title head html body".split())
PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th tr tbody table ul ol dl figcaption".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select", "datalist"}}

#: Elements that never hold main text, and words of class, id or role that mark such (fixed values).
ASIDE = set("head script style title textarea xmp noembed noframes iframe nav aside form fieldset button select template noscript dialog menu svg object canvas".split())
MARKS = set("nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside header masthead banner footer foot ad ads advert adverts advertisement sponsor sponsored promo cookie cookies consent notice gdpr popup modal newsletter subscribe signup comment comments commentlist disqus respond reply share sharing social related recommended widget login search contentinfo complementary".split())

#: Marks that, as a whole class, id or role, part an element inside the article from it (fixed values).
INSIDE = set("nav navbar navigation menu breadcrumb breadcrumbs sidebar ad ads advert adverts advertisement sponsored promo cookie-notice cookie-banner cookies consent gdpr popup modal newsletter subscribe signup comments comment-list commentlist comment-form disqus_thread respond share-buttons social-share sharing related-posts widget complementary contentinfo".split())

# possessive throughout: a tag that never ends is scanned once, not from each of its characters
_TAG = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*+(?:>|$)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|$)""", re.S)
_MARK = re.compile(r"""(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")


@dataclass
class Node:
    tag: str
    words: frozenset = frozenset()
    marks: frozenset = frozenset()
    parts: list = field(default_factory=list)
    digest: int = 0


def parse(html: str) -> Node:
    """A light element tree: implied ends of p, li, dt, dd, tr, td, th and option; inline elements are
    transparent, so an unclosed one can't swallow what follows."""
    root = Node("#root")
    stack, at, n = [root], 0, len(html)
    # where each open element stands in the stack, so that closing one never walks it
    where: dict[str, list[int]] = defaultdict(list)
    above = BLOCK - {"p"}

    def text(s: str) -> None:
        if s:
            stack[-1].parts.append(entities.unescape(s))

    def last(names) -> int:
        return max((where[x][-1] for x in names if where.get(x)), default=0)

    def close(names, stop=()) -> None:
        k = last(names)
        if k and k > last(stop):
            for x in stack[k:]:
                where[x.tag].pop()
            del stack[k:]

    while at < n:
        m = _TAG.search(html, at)
        if not m:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        attrs = m[3] if m[2] else m[6]
        if m[1] or m[4]:
            if name in BLOCK or name in RAW or name in ASIDE:
                close((name,))
            continue
        if name == "br":
            stack[-1].parts.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                close(("p",), above if where.get("p") else ())
                stack[-1].parts.append(None)
            continue
        if name not in BLOCK and name not in RAW and name not in ASIDE:
            continue
        if name in CLOSES_P:
            close(("p",), above if where.get("p") else ())
        if name in CLOSED_BY:
            close(CLOSED_BY[name], SCOPES[name])
        named = [next(filter(None, m2.groups()), "").lower() for m2 in _MARK.finditer(attrs)] if attrs else []
        node = Node(name, frozenset(w for x in named for w in _WORD.findall(x)), frozenset(w for x in named for w in x.split()))
        stack[-1].parts.append(node)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*[^>]*(?:>|$)", re.I).search(html, at)
            node.parts.append(html[at : end.start()] if end else html[at:])
            at = end.end() if end else n
        elif not attrs.rstrip().endswith("/") or name in BLOCK:
            where[name].append(len(stack))
            stack.append(node)
    return root


def _signed(text: str) -> int:
    import xxhash

    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 7)
    return h - (1 << 64) if h >> 63 else h


def digest(node: Node) -> int:
    """Signed 64-bit hash of the subtree: tag, marks, text with its white space made alike, and children."""
    todo, order = [node], []
    while todo:
        x = todo.pop()
        order.append(x)
        todo += [c for c in x.parts if isinstance(c, Node)]
    for x in reversed(order):
        own = [x.tag, *sorted(x.words)]
        for c in x.parts:
            own.append(f"\x01{c.digest}" if isinstance(c, Node) else " ".join((c or "").split()))
        x.digest = _signed("\x00".join(own))
    return node.digest


def content(root: Node) -> list[Node]:
    """The outermost main and article elements, but those in elements that hold no main text, in page order; else the whole page."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        if x.tag in ASIDE or (x.words & MARKS and x.tag not in ("html", "body", "main")):
            continue
        if x.tag in ("article", "main") or "main" in x.marks and x.tag == "div":
            out.append(x)
        else:
            todo += [c for c in reversed(x.parts) if isinstance(c, Node)]
    return out or [root]


def dropped(x: Node, inside: bool) -> bool:
    """What names itself no main text: by element name and, outside the article, any word of its marks; inside it only by a whole mark."""
    if x.tag in ASIDE or (x.tag in ("header", "footer") and not inside) or (inside and x.tag == "footer"):
        return True
    return bool(x.marks & INSIDE if inside else x.words & MARKS) and x.tag not in ("html", "body", "main", "article", "p", "h1", "h2", "h3", "h4", "h5", "h6")


def blocks(root: Node, templates: frozenset, inside: bool) -> list[str]:
    """Texts of the blocks below ``root`` in page order, without templates and elements that hold no main text."""
    out, now, todo = [], [], [root]

    def flush() -> None:
        if s := " ".join("".join(now).split()):
            out.append(s)
        now.clear()

    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            now.append(x)
        elif x is root or not (dropped(x, inside) or (x.digest in templates and not (inside and x.tag in PROSE))):
            flush()
            todo.append(None)
            todo += reversed(x.parts)
    flush()
    return out


def main_text(root: Node, templates: frozenset = frozenset()) -> str:
    """Text of a parsed and digested page, blocks joined by one blank."""
    return " ".join(t for x in content(root) for t in blocks(x, templates, inside=x is not root))


def subtrees(root: Node) -> tuple[set[tuple[int, bool]], int]:
    """(digest, whether it is prose of a page without article) of all block subtrees that a site could repeat, prose of the article not among them;
    and a digest of the main elements, by which copies of a page are known."""
    mains = content(root)
    own, out, todo = set(map(id, mains)), set(), [(root, False)]
    while todo:
        x, inside = todo.pop()
        inside = inside or (x is not root and id(x) in own)
        for c in x.parts:
            if isinstance(c, Node):
                if id(c) not in own and c.tag not in ("html", "body", "head") and not (inside and c.tag in PROSE):
                    out.add((c.digest, c.tag in PROSE and mains[0] is root))
                todo.append((c, inside))
    return out, mains[0].digest if len(mains) == 1 else _signed(" ".join(str(x.digest) for x in mains))


def extract(pages: DataFrame, many: int = 5, share: float = 0.02, most_pages: float = 0.5, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every row.

    Site templates: every block element's subtree is hashed; a hash that occurs on at least
    ``many`` pages of one host with different main elements, and on ``share`` of that host's pages, is that site's template, and
    such subtrees are deleted. Copies of one page count once. Paragraphs, headings, lists and tables of the
    article are never templates, so that it stays whole wherever it recurs; on pages without article such blocks are templates
    only from ``most_pages`` of the host's pages on. What no site repeats often enough, or a host of few pages shows, goes by the documented fallback: element
    names and marks of menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments. The text of
    all outermost article and main elements, else of the page, remains.

    Counting is a pre-aggregated group-by on (host, hash), so a host with a third of the pages is
    no hot task; a page meets its own deletions by its host and a hash of its html, so what a task that runs again
    reads decides nothing. A null or empty html gives an
    empty text; rows without host share the empty host; repeated rows come out as often as
    they go in; an empty table gives no rows; other columns are ignored.
    """
    host, _ = host_and_path(F.col(url))
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.coalesce(html, F.lit("")).alias("_html"), host.alias("_host"))
    rows = rows.withColumn("_p", F.xxhash64("_html"))
    since = shared.mark()

    def hashes(batches):
        for b in batches:
            out: list[tuple] = []
            for p, at, page in zip(*(b.column(c).to_pylist() for c in ("_p", "_host", "_html")), strict=True):
                root = parse(page)
                digest(root)
                own, main = subtrees(root)
                out += [(p, at, h, prose, main) for h, prose in own]
                out.append((p, at, 0, False, main))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["_p", "_host", "hash", "prose", "main"])

    seen = shared.cut(rows.select("_p", "_host", "_html").mapInArrow(shared.trimmed(hashes), "_p long, _host string, hash long, prose boolean, main long"), "subtrees")
    # hash 0 stands for the page itself
    counted = seen.groupBy("_host", "hash", "main").agg(F.max("prose").alias("prose")).groupBy("_host", "hash").agg(F.count("*").alias("n"), F.max("prose").alias("prose"))
    whole = counted.where("hash = 0").select("_host", F.col("n").alias("pages"))
    enough = F.greatest(F.lit(many), F.ceil(F.col("pages") * F.when(F.col("prose"), F.lit(most_pages)).otherwise(F.lit(share))))
    templates = shared.cut(counted.where(F.col("n") >= many).where("hash <> 0").join(whole.hint("shuffle_hash"), "_host").where(F.col("n") >= enough).select("_host", "hash"), "templates")
    deleted = shared.cut(seen.select("_p", "_host", "hash").join(templates.hint("shuffle_hash"), ["_host", "hash"]).groupBy("_host", "_p").agg(F.collect_set("hash").alias("_gone")), "deleted")
    shared.release(pages.sparkSession, since, but=1)

    def texts(batches):
        for b in batches:
            out = []
            for page, gone in zip(b.column("_html").to_pylist(), b.column("_gone").to_pylist(), strict=True):
                root = parse(page)
                if gone:
                    digest(root)
                out.append(main_text(root, frozenset(gone or ())))
            yield pa.RecordBatch.from_arrays([b.column("_key"), b.column("_url"), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], names=[key, url, "text", "n_chars"])

    both = rows.join(deleted.hint("shuffle_hash"), ["_host", "_p"], "left")
    schema = T.StructType([pages.schema[key], pages.schema[url], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return both.select("_key", "_url", "_html", "_gone").mapInArrow(shared.trimmed(texts), schema)
