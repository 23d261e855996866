"""Main text of web pages by templates deduced from equivalence classes.

Tokens of a page are its elements, told apart by their path (tags, classes and ids from the root, digits as one), and its whole text
runs below such a path. Tokens of one host whose occurrence vectors (how often in each of the host's pages) agree are an
equivalence class. A class is kept where it is frequent (in two pages and in a tenth of the host's) and nests, that is, hangs at
one place of the element tree; in a page it counts only where its elements come in the template's order. Nested classes are
the template: its fixed text runs are wording of the site, what else stands below its elements are slots. The slot that holds the article is
looked for from the top: an `article` or `main` element, else the child with most of the text that is neither fixed nor linked, as long as
one child has most of it. Elements that by tag, role, class or id are menus, headers, footers, sidebars, notices, adverts, forms or
comments are left out, and so are elements whose text is fixed or linked on nearly all of many pages. A page of a
host without a template (few pages) is treated alike by itself.

How it scales: occurrence vectors are never built. A token's vector is a sum, over pages, of a hash of page and count, so tasks
add up their own tokens before the shuffle and a host with a third of all pages is a few rows a task. A host's template has at most
ten times the tokens of its mean page; templates are broadcast where all of them together are under `broadcast_bytes`, else joined by
host (adaptive execution splits hot hosts). Pages are parsed twice, never shuffled in the first case.

Odd rows: null html is empty and gives an empty text; null urls are one host; repeated rows give a row each; very long pages are
read whole, in linear time; ties of slots go to the first in the page. An empty table gives none. Further columns are ignored.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
UNFINISHED = re.compile(r"</?[a-zA-Z][^<>]*\Z")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: Fixed values of HTML: elements without content, with raw text, without a line of their own, and such as end an open paragraph or item.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noframes noembed xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt", ("dl",)), "dd": ("dd", ("dl",)), "tr": ("tr", ("table",)), "td": ("td", ("tr", "table")), "th": ("th", ("tr", "table")), "option": ("option", ("select",))}
BOXES = frozenset("html body div section main article td table tbody tr center".split())

#: Elements that are never the article's text, by tag, by role and by a word of class or id.
TAGS = frozenset("head nav footer aside form noscript template button select datalist fieldset object svg canvas audio video dialog menu".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WORDS = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs masthead topbar footer sidebar ad ads advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored"
    " comment comments disqus respond replies share sharing social related recommended newsletter subscribe signup login cookie cookies consent gdpr notice notices popup modal pagination pager toolbar".split()
)
#: A class that begins so says what a page has, not what the element is.
ABOUT = ("has", "with", "without", "no", "is")

FREQUENT, MANY, MOST, NEARLY = 0.1, 8, 0.6, 0.95


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


class Page:
    """A page's elements (parent, tag, signature of the path, left out or not) and its text runs (element, block, text, linked)."""

    def __init__(self, html: str):
        self.parent, self.tag, self.sig, self.out, self.soft = [-1], [""], [0], [False], [False]
        self.runs: list[tuple[int, int, str, bool]] = []
        self._read(html)
        self._settle()

    def _read(self, html: str) -> None:
        stack, opened, block, at, breaks = [0], {}, 0, 0, 0
        end = len(html)

        def text(upto: int) -> None:
            nonlocal breaks
            if upto > at and (run := html[at:upto]) and not run.isspace():
                self.runs.append((stack[-1], block, references.unescape(run) if "&" in run else run, opened.get("a", 0) > 0))
                breaks = 0
            elif upto > at and self.runs and self.runs[-1][1] == block:
                self.runs.append((stack[-1], block, " ", False))

        def close(name: str) -> None:
            while len(stack) > 1:
                tag = self.tag[stack.pop()]
                opened[tag] -= 1
                if tag == name:
                    break

        while at < end:
            m = TAG.search(html, at)
            text(m.start() if m else cut.start() if (cut := UNFINISHED.search(html, at)) else end)
            if not m:
                break
            at = m.end()
            name = m.group(2) or m.group(5)
            if not name:
                continue
            name, ends = name.lower(), m.group(1) or m.group(4)
            if name == "br":
                breaks += 1
                if breaks > 1:
                    block += 1
                self.runs.append((stack[-1], block, " ", False))
                continue
            if name not in INLINE:
                block, breaks = block + 1, 0
            if ends:
                if opened.get(name):
                    close(name)
                continue
            if name not in INLINE and opened.get("p") and name not in VOID | RAW:
                close("p")
            elif name in CLOSES and opened.get(CLOSES[name][0]):
                own, limits = CLOSES[name]
                for i in reversed(stack):
                    if self.tag[i] in limits:
                        break
                    if self.tag[i] == own:
                        close(own)
                        break
            element = self._add(stack[-1], name, m.group(3) or m.group(6) or "")
            if name in RAW:
                stop = re.compile(f"</{name}(?=[\\s/>])[^>]*>", re.I).search(html, at)
                at = stop.end() if stop else end
            elif name not in VOID:
                stack.append(element)
                opened[name] = opened.get(name, 0) + 1

    def _add(self, parent: int, tag: str, attributes: str) -> int:
        of = {k.lower(): next((v for v in rest if v), "") for k, *rest in ATTRIBUTE.findall(attributes)} if attributes else {}
        names = sorted(of.get("class", "").split()) + ([f"#{of['id']}"] if of.get("id") else [])
        key = re.sub(r"\d+", "0", f"{tag} {' '.join(names)}")
        self.parent.append(parent)
        self.tag.append(tag)
        self.sig.append(xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"), self.sig[parent]))
        hidden = of.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", of.get("style", ""), re.I) is not None or re.search(r"(?:^|\s)hidden(?=\s|$|=)", ATTRIBUTE.sub(" ", attributes)) is not None
        self.out.append(tag in TAGS - {"form"} or of.get("role", "").lower() in ROLES or hidden)
        named = tag not in ("html", "body", "main") and any((w := [x.lower() for x in WORD.findall(n)]) and w[0] not in ABOUT and WORDS.intersection(w) for n in names)
        self.soft.append(named or tag == "form")
        if tag == "header" or any("header" in WORD.findall(n) for n in names) and tag not in ("html", "body", "main", "article"):
            up = parent
            while up > 0 and self.tag[up] not in ("article", "main"):
                up = self.parent[up]
            self.soft[-1] = self.soft[-1] or up <= 0
        return len(self.tag) - 1

    def _settle(self) -> None:
        """What only wraps the page's first article is no menu, whatever its name; what stands within something left out is left out."""
        hard = [False] * len(self.tag)
        for i in range(1, len(self.tag)):
            hard[i] = self.out[i] or hard[self.parent[i]]
        body = next((i for i in range(1, len(self.tag)) if self.tag[i] in ("article", "main") and not hard[i] and not self.soft[i]), 0)
        while body > 0:
            self.soft[body] = False
            body = self.parent[body]
        for i in range(1, len(self.tag)):
            self.out[i] = hard[i] or self.soft[i] or self.out[self.parent[i]]

    def tokens(self) -> dict[int, list]:
        """token -> [count, parent token, tag, chars, linked chars, place]: elements that are not left out, with the text below them, and text runs."""
        n = len(self.tag)
        chars, linked = [0] * n, [0] * n
        found: dict[int, list] = {}
        for k, (element, _, text, link) in enumerate(self.runs):
            size = len(text.strip())
            if not size or self.out[element]:
                continue
            chars[element] += size
            linked[element] += size if link else 0
            token = xxhash.xxh64_intdigest(" ".join(text.split()).encode("utf-8", "surrogatepass"), self.sig[element] ^ 1)
            if token in found:
                found[token][0] += 1
            else:
                found[token] = [1, self.sig[element], "", size, size if link else 0, k]
        for i in range(n - 1, 0, -1):
            chars[self.parent[i]] += chars[i]
            linked[self.parent[i]] += linked[i]
        for i in range(1, n):
            if self.out[i]:
                continue
            own = found.setdefault(self.sig[i], [0, self.sig[self.parent[i]], self.tag[i], 0, 0, i])
            own[0] += 1
            own[3] += chars[i]
            own[4] += linked[i]
        return found

    def text(self, region: set[int], without: set[int]) -> list[str]:
        """Blocks of the text below the elements of `region`, but for what is left out and what is below elements of `without`."""
        n = len(self.tag)
        inside, gone = [0 in region] * n, [False] * n
        for i in range(1, n):
            up = self.parent[i]
            inside[i] = inside[up] or self.sig[i] in region
            gone[i] = gone[up] or self.out[i] or self.sig[i] in without
        blocks: dict[int, list[str]] = {}
        for element, block, text, _ in self.runs:
            if inside[element] and not gone[element]:
                blocks.setdefault(block, []).append(text)
        lines = (" ".join("".join(parts).split()) for _, parts in sorted(blocks.items()))
        return [line for line in lines if line]


class Template:
    """Tokens of one host, (token, parent, tag, pages, count, vector, chars, linked), in nested equivalence classes."""

    def __init__(self, rows: list[tuple], pages: int):
        self.pages = pages
        known = {r[0]: r for r in rows}
        classes: dict[tuple, list] = {}
        for r in rows:
            classes.setdefault((r[5], r[3], r[4]), []).append(r)
        self.of: dict[int, tuple] = {}
        for name, members in classes.items():
            own = {r[0] for r in members}
            if len({r[1] for r in members if r[1] not in own and r[2]}) <= 1:  # its elements hang at one place
                self.of.update({r[0]: name for r in members})
        self.rows = {t: r for t, r in known.items() if t in self.of}
        self.fixed: dict[int, int] = {}
        for t, r in self.rows.items():
            if not r[2]:
                up = r[1]
                while up in known:
                    self.fixed[up] = self.fixed.get(up, 0) + r[6]
                    up = known[up][1]

    def slots(self, present: list[int]) -> tuple[set[int], set[int]]:
        """(elements that hold the article, elements to leave out) of a page with the elements `present`, in page order."""
        here = [t for t in dict.fromkeys(present) if t in self.rows and self.rows[t][2]]
        children: dict[int, list] = {}
        for t in here:
            children.setdefault(self.rows[t][1], []).append(t)
        free = {t: max(0, self.rows[t][6] - self.rows[t][7] - self.fixed.get(t, 0)) / self.rows[t][3] for t in here}
        whole = {t: (self.rows[t][6] - self.rows[t][7]) / self.rows[t][3] for t in here}
        weight = free if sum(free[t] for t in children.get(0, [])) > 0.5 * sum(whole[t] for t in children.get(0, [])) else whole  # copies of one page fix all of it
        top = sum(weight[t] for t in children.get(0, []))
        named = [t for t in here if self.rows[t][2] in ("article", "main")]
        region = max(named, key=lambda t: weight[t], default=0)
        if region and weight[region] >= top / 4:
            inner = [t for t in named if t != region and self._below(t, region) and weight[t] >= MOST * weight[region]]
            region = inner[-1] if inner else region
        else:
            region, size = 0, top
            while boxes := [t for t in children.get(region, []) if self.rows[t][2] in BOXES]:
                best = max(boxes, key=lambda t: weight[t])
                if weight[best] < MOST * size or weight[best] == 0:
                    break
                region, size = best, weight[best]
        without = set()
        if self.pages >= MANY and weight is free:
            for t in here:
                r = self.rows[t]
                if t != region and r[2] not in ("h1", "html", "body", "article", "main") and r[3] >= MANY and self._below(t, region) and r[6]:
                    listed = r[2] in ("ul", "ol", "table", "div", "section") and r[7] >= NEARLY * r[6]
                    if listed or self.fixed.get(t, 0) >= NEARLY * r[6]:
                        without.add(t)
        return {region}, without

    def _below(self, token: int, region: int) -> bool:
        while token in self.rows:
            if token == region:
                return True
            token = self.rows[token][1]
        return region == 0


def extract(html: str | None, template: Template | None) -> str:
    """The main text of a page, by its host's template or, where the page does not fit one, by itself."""
    page = Page(html or "")
    present = [s for s, out in zip(page.sig, page.out) if not out]
    if template is not None:
        region, without = template.slots(present[1:])
        lines = page.text(region, without)
        if all(t in template.rows for t in present[1:]) or sum(map(len, lines)) >= sum(map(len, page.text({0}, set()))) / 2:
            return "\n".join(lines)
    own = Template([(t, v[1], v[2], 1, v[0], v[0], v[3], v[4]) for t, v in page.tokens().items() if v[2]], 1)
    return "\n".join(page.text(*own.slots(present[1:])))


TOKENS = "host string, token long, parent long, tag string, pages long, n long, vector long, chars long, linked long"


def host_of(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def host_tokens(pages: DataFrame, flush: int = 200_000) -> DataFrame:
    """Tokens by host with the number of their pages and occurrences and the hash of their occurrence vector; token 0 is the page itself."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list] = {}

        def batch() -> pa.RecordBatch:
            columns = list(zip(*((h, signed(t), *v[:2], v[2], v[3], signed(v[4]), *v[5:]) for (h, t), v in found.items()))) or [()] * 9
            found.clear()
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in TOKENS.split(", ")])

        for rows in batches:
            for host, key, html in zip(*(c.to_pylist() for c in rows.columns)):
                page = Page(html or "")
                for token, (count, parent, tag, chars, linked, _) in (page.tokens() | {0: [1, 0, "", 0, 0, 0]}).items():
                    old = found.setdefault((host, token), [signed(parent), tag, 0, 0, 0, 0, 0])
                    old[2] += 1
                    old[3] += count
                    old[4] = (old[4] + xxhash.xxh64_intdigest(count.to_bytes(8, "little"), key & (1 << 64) - 1)) & (1 << 64) - 1
                    old[5] += chars * (count if not tag else 1)
                    old[6] += linked * (count if not tag else 1)
                if len(found) >= flush:
                    yield batch()
        yield batch()

    rows = pages.select(host_of().alias("host"), F.xxhash64("page_id", "url", "html").alias("key"), "html")
    sums = ("pages", "n", "vector", "chars", "linked")
    parts = rows.mapInArrow(counted, TOKENS)
    # sums of hashes wrap around on purpose: as halves, they stay within a long where ANSI arithmetic would refuse
    parts = parts.withColumns({"low": F.col("vector").bitwiseAND((1 << 32) - 1), "high": F.shiftrightunsigned("vector", 32)})
    each = parts.groupBy("host", "token").agg(F.first("parent").alias("parent"), F.first("tag").alias("tag"), *(F.sum(c).alias(c) for c in sums if c != "vector"), F.sum("low").alias("low"), F.sum("high").alias("high"))
    return each.withColumn("vector", F.xxhash64(F.col("low"), F.col("high"))).drop("low", "high")


def templates(pages: DataFrame) -> DataFrame:
    """(host, pages, tokens) of hosts with two pages or more: the frequent tokens, at most ten times as many as a mean page has."""
    tokens = host_tokens(pages)
    tokens = stored(tokens.where("pages > 1"), "tokens")
    hosts = tokens.where("token = 0").select("host", F.col("pages").alias("all_pages"))
    frequent = tokens.where("token <> 0").join(hosts, "host").where(F.col("pages") >= FREQUENT * F.col("all_pages"))
    row = F.struct("token", "parent", "tag", "pages", "n", "vector", "chars", "linked")
    return frequent.groupBy("host").agg(F.first("all_pages").alias("all_pages"), F.collect_list(row).alias("tokens"))


def extracted(pages: DataFrame, broadcast_bytes: int = 1 << 26) -> DataFrame:
    """(page_id, url, text, n_chars, n_classes): each page's main text, and how many classes its host's template has."""
    made = stored(templates(pages), "templates")
    size = made.agg(F.sum(F.size("tokens") * 72 + F.length("host"))).first()[0] or 0
    rows = pages.select("page_id", "url", "html", host_of().alias("host"))
    both = rows.join(F.broadcast(made) if size <= broadcast_bytes else made, "host", "left").drop("host")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Template] = {}
        for batch in batches:
            lists = batch.column("tokens")
            texts, sizes = [], []
            for i, (html, pages_) in enumerate(zip(batch.column("html").to_pylist(), batch.column("all_pages").to_pylist())):
                template = None
                if pages_ is not None:
                    rows_ = lists[i].as_py()
                    name = hash((pages_, len(rows_), rows_[0]["vector"], rows_[0]["token"])) if rows_ else 0
                    if name not in known:
                        if len(known) >= 256:
                            known.clear()
                        u = lambda x: x & (1 << 64) - 1
                        known[name] = Template([(u(r["token"]), u(r["parent"]), r["tag"], r["pages"], r["n"], r["vector"], r["chars"], r["linked"]) for r in rows_], pages_)
                    template = known[name]
                texts.append(extract(html, template))
                sizes.append(len(set(template.of.values())) if template else 0)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(sizes, pa.int64())], ["page_id", "url", "text", "n_chars", "n_classes"])

    return both.mapInArrow(read, "page_id long, url string, text string, n_chars long, n_classes long")
