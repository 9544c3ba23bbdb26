"""Main text of web pages: a recurrent block labeller.

A page is cut into leaf blocks, runs of text between block-level tags. Each block is a vector: its tag path (names, and
classes, ids and roles, hashed whole and as letter triples), its hashed words, and a few measures of its shape. A
bidirectional LSTM in numpy reads the blocks of the whole page and gives each the probability that it belongs to the
article; blocks of 1/2 or more are the text, joined in page order.

The network is fitted on pages that a generator lays out from random words: articles in many wrappings among menus, headers,
footers, sidebars, notices, adverts, forms and reader comments, with the unclosed tags that real pages have. Labels come from
the layout, words say nothing. Fitting is deterministic and happens once a process.

Defined results: null and empty pages have an empty text, as have pages without a block; a page that isn't HTML is one
block; repeated rows are extracted alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html as references
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The elements of HTML that start and end a block, that have no content, and whose content isn't text of the page.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style template noscript svg math object canvas audio video iframe title textarea".split())
#: An opening tag ends these elements where one of them is open and not outside the second set.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

PATH_DIMS = 384
WORD_DIMS = 64
SHAPE_DIMS = 8
WIDTH = 24
UNITS = 16
FIT_PAGES = 1000
EPOCHS = 5
#: Characters of pages that are read at once.
AT_ONCE = 4 << 20

TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
MARK = re.compile("[>\"']")
#: The elements that may stand in a head; any other, and text, ends it.
HEAD = frozenset("head html base basefont bgsound link meta title script style template noscript".split())
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def _bucket(s: str, n: int) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) % n


class Paths:
    """Numbers for tag paths, and their vectors: 32 for the leaf's name, 96 for names and classes on the path, 256 for letter triples of classes."""

    def __init__(self) -> None:
        self.known: dict[tuple[int, str, str], int] = {}
        self.vectors = [np.zeros(PATH_DIMS, np.float32)]
        self.below = [frozenset[int]()]

    def down(self, path: int, tag: str, attributes: str) -> int:
        named = " ".join("".join(x) for x in NAMES.findall(attributes)) if "=" in attributes else ""
        key = path, tag, named
        if (at := self.known.get(key)) is None:
            on = {32 + _bucket("t:" + tag, 96)} if tag in BLOCK else set()
            for word in re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", named).lower()):
                on.add(32 + _bucket("c:" + word.removesuffix("s"), 96))
                edged = f"^{word}$"
                on.update(128 + _bucket(edged[i : i + 3], 256) for i in range(len(edged) - 2))
            at = self.known[key] = len(self.vectors)
            below = self.below[path] | on
            v = np.zeros(PATH_DIMS, np.float32)
            v[list(below)] = 1
            v[_bucket(tag, 32)] = 1
            self.below.append(below)
            self.vectors.append(v)
        return at


class _Ends:
    """Where tags end, as TAG has it, in time linear in the page however many tags don't: each mark is followed once."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.after: dict[int, int] = {}  # a mark outside quotes to the next one, or to itself if it is the end
        self.near = (0, -1)  # no mark from the first number on before the second
        self.last = {q: page.rfind(q) for q in ">\"'"}

    def mark(self, at: int) -> int:
        """The next mark, -1 if none follows."""
        lo, hi = self.near
        if not lo <= at <= hi:
            if at > max(self.last.values()):
                return -1
            hi = MARK.search(self.page, at).start()
            self.near = at, hi
        return hi

    def follow(self, at: int) -> int:
        """Where the tag whose attributes start here has its '>', -1 if nowhere."""
        passed, now = [], self.mark(at)
        while now >= 0:
            if (known := self.after.get(now)) is not None:
                now = known
                break
            if (c := self.page[now]) == ">":
                break
            passed.append(now)
            now = self.mark(self.page.find(c, now + 1) + 1) if self.last[c] > now else -1
        self.after.update(dict.fromkeys(passed, now))
        return now


def blocks(page: str, paths: Paths) -> list[tuple[int, str, int]]:
    """(path, text, characters in links) of each block with text; entities are decoded, white space is one space."""
    out: list[tuple[int, str, int]] = []
    stack: list[tuple[str, int, int]] = []  # tag, path, path of its block-level elements
    opened: dict[str, int] = {}
    run: list[str] = []
    linked, in_link, head = 0, 0, 0
    path, at, n = 0, 0, len(page)
    ends: _Ends | None = None  # made when a tag doesn't end

    def close() -> None:
        nonlocal linked
        if run:
            text = "".join(run)
            text = " ".join((references.unescape(text) if "&" in text else text).split())
            if text and not head:
                out.append((path, text, linked))
            run.clear()
        linked = 0

    def pop() -> None:
        nonlocal in_link, head
        tag = stack.pop()[0]
        opened[tag] -= 1
        in_link -= tag == "a"
        head -= tag == "head"

    def end_head() -> None:
        nonlocal path
        while opened.get("head"):
            pop()
        path = stack[-1][2] if stack else 0

    while at < n:
        lt = page.find("<", at)
        text = page[at:lt] if lt >= 0 else page[at:]
        if text:
            if head and not text.isspace():
                end_head()
            run.append(text)
            if in_link:
                linked += len(text)
        if lt < 0:
            break
        c = page[lt + 1 : lt + 2]
        if c in "!?" and c:
            end = page.find("-->", lt + 4) + 2 if page.startswith("<!--", lt) else page.find(">", lt)
            at = end + 1 if end > lt else n
            continue
        m = NAME.match(page, lt)
        if m is None:  # not a tag
            if head:
                end_head()
            run.append("<")
            at = lt + 1
            continue
        if ends is None:
            if (whole := TAG.match(page, lt)) is None:
                ends = _Ends(page)
            else:
                end = whole.end() - 1
        if ends is not None:
            end = ends.follow(m.end())
        if end >= 0:
            tag, attributes = m[1].lower(), page[m.end() : end]
        else:  # quotes that don't end: to the next '>'
            end = page.find(">", lt) if ends.last[">"] > lt else -1
            m = TAG.match(page[lt : end + 1].replace('"', "").replace("'", "")) if end > 0 else None
            if m is None:  # not a tag
                if head:
                    end_head()
                run.append("<")
                at = lt + 1
                continue
            tag, attributes = m[1].lower(), m[2]
        at = end + 1
        if head and tag not in HEAD and page[lt + 1] != "/":
            end_head()
        if page[lt + 1] == "/":
            if tag in BLOCK:
                close()
            if opened.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
                path = stack[-1][2] if stack else 0
            continue
        if tag in SKIPPED:
            if tag in BLOCK:
                close()
            if not attributes.endswith("/"):
                found = re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(page, at)
                at = found.end() if found else n if tag in ("script", "style", "title", "textarea") else at
            continue
        if tag == "br":
            run.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                close()
            continue
        if tag in BLOCK:
            close()
            inner, outer = ENDS.get(tag, ((), ()))
            if tag not in ("option", "button", "label") and opened.get("p"):
                inner, outer = {*inner, "p"}, {*outer, "table", "button"}
            k = len(stack) - 1
            while inner and k >= 0 and stack[k][0] not in outer:
                if stack[k][0] in inner:
                    while len(stack) > k:
                        pop()
                k -= 1
        within = stack[-1][2] if stack else 0
        if tag in BLOCK:
            path = within = paths.down(within, tag, attributes)
        stack.append((tag, path, within))
        opened[tag] = opened.get(tag, 0) + 1
        in_link += tag == "a"
        head += tag == "head"
    close()
    return out


class _Words:
    """Buckets of words, remembered up to a bound."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def counts(self, text: str) -> np.ndarray:
        words = text.split(" ")
        known = self.known
        try:
            own = [known[w] for w in words]
        except KeyError:
            if len(known) > 300_000:
                known.clear()
            for w in set(words):
                known.setdefault(w, _bucket(w.lower(), WORD_DIMS))
            own = [known[w] if w in known else _bucket(w.lower(), WORD_DIMS) for w in words]
        return np.bincount(own, minlength=WORD_DIMS) / len(own)


def _shapes(found: list[tuple[int, str, int]], words: _Words) -> np.ndarray:
    """Hashed words and shape of each block; float32."""
    out = np.zeros((len(found), WORD_DIMS + SHAPE_DIMS), np.float32)
    for k, (_, text, linked) in enumerate(found):
        n = len(text)
        spaces = text.count(" ")
        out[k, :WORD_DIMS] = words.counts(text)
        out[k, WORD_DIMS:] = np.log1p(n) / 8, np.log1p(spaces) / 6, min(1.0, linked / n), text[-1] in ".!?:;\"'", text.count(".") * 10 / n, text.count(",") * 10 / n, "©" in text, 1.0
    return out


Model = dict[str, np.ndarray]


def _padded(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sequences laid out one after another: (time, sequence) to row, -1 for padding; and the same backwards."""
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    t = np.arange(sizes.max())[:, None]
    on = t < sizes
    return np.where(on, first + t, -1), np.where(on, first + sizes - 1 - t, -1)


def _lstm(x: np.ndarray, u: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """x: (time, sequence, 4 units) with bias; the states by time."""
    h = np.zeros((x.shape[1], UNITS), np.float32)
    c = np.zeros_like(h)
    out, kept = np.empty((*x.shape[:2], UNITS), np.float32), []
    for t in range(len(x)):
        a = x[t] + h @ u
        g = 1 / (1 + np.exp(-np.clip(a[:, : 3 * UNITS], -30, 30)))
        i, f, o, z = g[:, :UNITS], g[:, UNITS : 2 * UNITS], g[:, 2 * UNITS :], np.tanh(a[:, 3 * UNITS :])
        before, prior = c, h
        c = f * c + i * z
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        if keep:
            kept.append((i, f, o, z, before, tc, prior))
    return out, kept


def _lstm_back(gh: np.ndarray, kept: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the inputs and of u, from those of the states."""
    gx = np.empty((*gh.shape[:2], 4 * UNITS), np.float32)
    gu, dh, dc = np.zeros_like(u), np.zeros_like(gh[0]), np.zeros_like(gh[0])
    for t in range(len(gh) - 1, -1, -1):
        i, f, o, z, before, tc, prior = kept[t]
        d = gh[t] + dh
        dc = dc + d * o * (1 - tc * tc)
        gx[t] = np.concatenate([dc * z * i * (1 - i), dc * before * f * (1 - f), d * tc * o * (1 - o), dc * i * (1 - z * z)], axis=1)
        gu += prior.T @ gx[t]
        dh, dc = gx[t] @ u.T, dc * f
    return gx, gu


def _forward(m: Model, path_rows: np.ndarray, path_of: np.ndarray, shape: np.ndarray, sizes: np.ndarray, keep: bool = False, ready: np.ndarray | None = None) -> dict:
    """Probabilities of all blocks; pages are laid out one after another. path_rows: the vectors of the paths that path_of names; ready: what the network makes of them, if known."""
    e = np.tanh((path_rows @ m["path"] if ready is None else ready)[path_of] + shape @ m["shape"])
    both = {}
    padded = _padded(sizes)
    states = []
    for k, at in enumerate(padded):
        x = np.where(at[..., None] >= 0, (e @ m[f"in{k}"] + m[f"b{k}"])[at], 0).astype(np.float32)
        out, kept = _lstm(x, m[f"u{k}"], keep)
        rows = np.empty((len(e), UNITS), np.float32)
        rows[at[at >= 0]] = out[at >= 0]
        states.append(rows)
        both[k] = (at, kept)
    s = np.concatenate([*states, e], axis=1)
    return {"e": e, "s": s, "both": both, "prob": 1 / (1 + np.exp(-np.clip(s @ m["v"] + m["d"], -30, 30)))}


def _new(rng: np.random.Generator) -> Model:
    g = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    m = {"path": rng.normal(0, 0.15, (PATH_DIMS, WIDTH)).astype(np.float32), "shape": g(WORD_DIMS + SHAPE_DIMS, WIDTH), "v": g(2 * UNITS + WIDTH), "d": np.zeros(1, np.float32)}
    for k in (0, 1):
        m |= {f"in{k}": g(WIDTH, 4 * UNITS), f"u{k}": g(UNITS, 4 * UNITS), f"b{k}": np.repeat(np.array([0, 1, 0, 0], np.float32), UNITS)}
    return m


def fit(pages: list[tuple[str, list[bool]]], seed: int = 5, epochs: int = EPOCHS) -> Model:
    """From pages and the label of each of their blocks; by Adam."""
    rng = np.random.default_rng(seed)
    paths, words, made = Paths(), _Words(), []
    for page, labels in pages:
        found = blocks(page, paths)
        assert len(found) == len(labels), (len(found), len(labels), page)
        if found:
            made.append((np.array([b[0] for b in found]), _shapes(found, words), np.array(labels, np.float32)))
    vectors = np.array(paths.vectors)
    m = _new(rng)
    a, v, t = {k: np.zeros_like(x) for k, x in m.items()}, {k: np.zeros_like(x) for k, x in m.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(made))
        for lo in range(0, len(order), 16):
            own = [made[i] for i in order[lo : lo + 16]]
            of, shape, y = (np.concatenate([o[j] for o in own]) for j in range(3))
            sizes = np.array([len(o[2]) for o in own])
            path_rows = vectors[of] * (rng.random((len(of), PATH_DIMS)) > 0.15)  # names the generator doesn't know are missing
            f = _forward(m, path_rows.astype(np.float32), np.arange(len(of)), shape, sizes, keep=True)
            g = ((f["prob"] - y) / len(y)).astype(np.float32)
            grad = {"v": f["s"].T @ g, "d": g.sum(keepdims=True)}
            gs = g[:, None] * m["v"]
            ge = gs[:, 2 * UNITS :].copy()
            for k in (0, 1):
                at, kept = f["both"][k]
                gh = np.where(at[..., None] >= 0, gs[:, k * UNITS : (k + 1) * UNITS][at], 0).astype(np.float32)
                gx, grad[f"u{k}"] = _lstm_back(gh, kept, m[f"u{k}"])
                rows = np.zeros((len(of), 4 * UNITS), np.float32)
                rows[at[at >= 0]] = gx[at >= 0]
                grad[f"in{k}"], grad[f"b{k}"] = f["e"].T @ rows, rows.sum(axis=0)
                ge += rows @ m[f"in{k}"].T
            ge *= 1 - f["e"] ** 2
            grad |= {"path": path_rows.T.astype(np.float32) @ ge, "shape": shape.T @ ge}
            t += 1
            rate = 0.01 * (1 - epoch / epochs) + 0.0005
            for k, x in grad.items():
                a[k] += 0.1 * (x - a[k])
                v[k] += 0.01 * (x * x - v[k])
                m[k] = (m[k] - rate * (a[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return m


def label(m: Model, pages: list[str]) -> list[list[tuple[str, float]]]:
    """For each page its blocks and their probabilities."""
    paths, words = Paths(), _Words()
    cut = [blocks(p, paths) for p in pages]
    vectors = np.array(paths.vectors)
    ready = vectors @ m["path"]  # once for all groups of pages
    out: list[list[tuple[str, float]]] = [[] for _ in pages]
    order = sorted((i for i, c in enumerate(cut) if c), key=lambda i: len(cut[i]))
    while order:
        n = 1
        longest = len(cut[order[0]])
        while n < len(order) and n < 512 and len(cut[order[n]]) <= 1.5 * longest + 4:
            n += 1
        own, order = order[:n], order[n:]
        found = [b for i in own for b in cut[i]]
        prob = _forward(m, vectors, np.array([b[0] for b in found]), _shapes(found, words), np.array([len(cut[i]) for i in own]), ready=ready)["prob"].tolist()
        at = 0
        for i in own:
            out[i] = [(b[1], p) for b, p in zip(cut[i], prob[at : at + len(cut[i])], strict=True)]
            at += len(cut[i])
    return out


def texts(m: Model, pages: list[str]) -> list[str]:
    return ["\n".join(t for t, p in found if p >= 0.5) for found in label(m, pages)]


@lru_cache(maxsize=1)
def trained(pages: int = FIT_PAGES) -> Model:
    from .layouts import pages as laid_out

    return fit(laid_out(pages))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each page, from its whole html."""
    held = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start, own, size = 0, [], 0
            for k, page in enumerate(b.column(2)):
                own.append(page.as_py() or "")
                size += len(own[-1])
                if size >= AT_ONCE or len(own) >= 2048 or k + 1 == b.num_rows:
                    found = texts(held.value, own)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(own)), b.column(1).slice(start, len(own)), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], names=["page_id", "url", "text", "n_chars"])
                    start, own, size = k + 1, [], 0

    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return pages.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint")
