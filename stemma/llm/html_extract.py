"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks: the runs of text between block-level tags, each with the
path of tags (and class, id and role words) above it. A bidirectional LSTM in numpy reads a vector for
each block (its hashed path, its hashed words, its place, size and share of link text) and labels every
block as article or not, with the whole page as context. The article's blocks are joined by a space.

The labeller is trained here on generated pages of many layouts and languages, with and without article
markup, and on at most SAMPLE pages of the table (the least by a hash of page_id) of up to SAMPLE_BYTES
together. The generator knows its labels. A sampled page teaches only where its markup says outright what a
block is: inside an article or main element, or in a nav, a footer, an element named for adverts and so on;
its other blocks are read as context. Pages of more than WINDOW blocks are learned in windows.

Scale: the weights (some 10,000 numbers) are broadcast; pages are read once more, without a shuffle, and
labelled in groups of like length. Memory is bounded by an Arrow batch, or by the longest page: reading is
linear in its length, and a path is a vector that an element shares with what it adds nothing to.

Edge cases: null, empty or article-less html gives an empty text; broken markup is read as browsers do for
the common cases (unclosed p, li, td; stray end tags; quotes in attributes; an unclosed script, comment or
tag runs to the end); an empty table gives an empty result; rows are independent; other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words
from ._common import bounded_batches, read

SAMPLE = 200
SAMPLE_BYTES = 16 << 20
WINDOW = 400
GENERATED = 3500
HIDDEN = 20
PATH_DIM, WORD_DIM = 192, 16
#: Elements whose content isn't text of the page.
RAW = frozenset("script style noscript template textarea title svg math iframe object select datalist canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
#: An opening tag of the key closes an open one of the values, up to the nearest stop.
_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Marks of what isn't the article, as tags and as words of class, id or role.
AWAY_TAGS = frozenset("nav footer aside form dialog menu button label search".split())
AWAY_WORDS = frozenset("ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies consent notice notices alert popup modal newsletter subscribe sidebar side widget menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments reply replies respond discussion share social related recommended login signup search form toolbar pagination legal copyright disqus trackbacks teaser outbrain taboola skip".split())
#: The same in other languages, and names of the article's element, for generated pages.
AWAY_ABROAD = "werbung anzeige kommentare kommentar fusszeile seitenleiste navigation hinweis publicite commentaires commentaire pied barre laterale avis publicidad comentarios comentario pie lateral anuncio aviso commenti reclame reacties zijbalk".split()
MAIN_WORDS = "content article post entry story body text main page detail news inhalt hauptteil hauptinhalt beitrag artikel contenu corps texte contenido cuerpo articulo noticia entrada contenuto testo inhoud bericht".split()

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_REST = re.compile(r"(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+>")
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")


class Path:
    """An open element: its own words, what is above it, and the vector of all distinct words."""

    __slots__ = ("name", "words", "above", "new", "vector")

    def __init__(self, name: str, words: list[str], above: Path | None, open_: Counter):
        self.name, self.words, self.above = name, words, above
        self.new = [w for w in dict.fromkeys(words) if not open_[w]]
        self.vector = above.vector if above else _NOTHING
        if self.new:
            self.vector = self.vector + path_vector(tuple(self.new))

    def all(self) -> tuple[str, ...]:
        out, at = [], self
        while at:
            out.append(at.words)
            at = at.above
        return tuple(w for words in reversed(out) for w in words)


def blocks(html: str) -> tuple[list[tuple[str, ...]], list[str], list[float]]:
    """(paths, texts, share of link text) of a page's leaf blocks, in page order."""
    paths, texts, links = leaves(html)
    return [p.all() if p else () for p in paths], texts, links


def leaves(html: str) -> tuple[list[Path | None], list[str], list[float]]:
    """blocks, with paths as they are read."""
    paths, texts, links = [], [], []
    stack: list[Path] = []
    open_: Counter = Counter()
    buffer: list[str] = []
    endless: set[str] = set()  # names of raw elements without an end tag from here on
    linked = in_link = 0
    loose = False

    def flush() -> None:
        nonlocal linked
        if buffer:
            raw = "".join(buffer)
            text = " ".join(html_lib.unescape(raw).split())
            if text:
                paths.append(stack[-1] if stack else None)
                texts.append(text)
                links.append(min(1.0, linked / len(raw)))
            buffer.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        buffer.append(text)
        if in_link:
            linked += len(text)

    def cut(k: int) -> None:
        for x in stack[k:]:
            open_.subtract(x.words)
        del stack[k:]

    at, n = 0, len(html)
    while at < n:
        here = html.find("<", at)
        if here < 0:
            add(html[at:])
            break
        if here > at:
            add(html[at:here])
        if html.startswith("<!--", here):
            end = html.find("-->", here + 4)
            at = n if end < 0 else end + 3
            continue
        closing = html.startswith("/", here + 1)
        named = _NAME.match(html, here + 1 + closing)
        if named is None:
            end = html.find(">", here) if closing or html[here + 1 : here + 2] in ("!", "?") else -1
            if end < 0:
                add("<")
            at = here + 1 if end < 0 else end + 1
            continue
        rest = None if loose else _REST.match(html, named.end())
        if rest:
            attributes, at = html[named.end() : rest.end() - 1], rest.end()
        else:
            loose = True  # a quote stays open to the end of the page: from here on, tags end at the next >
            end = html.find(">", named.end())
            if end < 0:
                break
            attributes, at = html[named.end() : end], end + 1
        name = named[0].lower()
        if closing:
            if name == "a":
                in_link = max(0, in_link - 1)
            if name in BLOCK:
                flush()
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].name == name), None) if open_[name] > 0 else None
            if k is not None and name not in ("html", "body"):
                cut(k)
            continue
        if name in BLOCK:
            flush()
            close, stop = ({"p"}, set()) if name in _P else _CLOSES.get(name, (set(), set()))
            if close and any(open_[c] > 0 for c in close):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].name in close:
                        cut(i)
                        if name not in ("tr", "dd", "dt"):
                            break
                    elif stack[i].name in stop or (name in _P and stack[i].name in BLOCK):
                        break
        if name in RAW and not attributes.rstrip().endswith("/"):
            end = None if name in endless else re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            if end is None:
                endless.add(name)
            at = end.end() if end else (n if name in ("script", "style", "textarea", "title") else at)
            continue
        if name in VOID:
            continue
        if name == "a":
            in_link += 1
        words = [name]
        if "=" in attributes:
            for key, *value in _ATTRIBUTE.findall(attributes):
                words += dict.fromkeys("." + w for w in _WORD.findall("".join(value).lower())) if key else []
        stack.append(Path(name, words, stack[-1] if stack else None, open_))
        open_.update(words)
    flush()
    return paths, texts, links


def away(path: tuple[str, ...]) -> bool:
    """Does the markup say outright that a block isn't of the article?"""
    seen_article = False
    for w in path:
        if w in ("article", "main"):
            seen_article = True
        if w in AWAY_TAGS or (w[0] == "." and w[1:] in AWAY_WORDS) or (w == "header" and not seen_article) or w == "head":
            return True
    return False


_NOTHING = np.zeros(PATH_DIM, np.float32)


@lru_cache(50_000)
def path_vector(words: tuple[str, ...]) -> np.ndarray:
    out = np.zeros(PATH_DIM, np.float32)
    for w in words:
        h = zlib.crc32(w.encode())
        out[h % PATH_DIM] += 1 if h >> 16 & 1 else -1
        h = zlib.crc32(b"2" + w.encode())
        out[h % PATH_DIM] += 1 if h >> 16 & 1 else -1
    return out


def vectors(pages: list[tuple[list, list[str], list[float]]]) -> tuple[np.ndarray, np.ndarray]:
    """(a row for each block of all pages, blocks of each page)."""
    sizes = np.array([len(p[0]) for p in pages])
    texts = [t for p in pages for t in p[1]]
    x = np.zeros((len(texts), PATH_DIM + WORD_DIM + 6), np.float32)
    if not texts:
        return x, sizes
    x[:, :PATH_DIM] = np.stack([_NOTHING if not q else q.vector if isinstance(q, Path) else path_vector(tuple(dict.fromkeys(q))) for p in pages for q in p[0]])
    raw, offsets = _words.buffers(pa.array(texts, pa.large_string()))
    for i, j in _words.slices(offsets):
        h, first = _words.word_hashes(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        n = np.diff(first)
        owner = np.repeat(np.arange(j - i), n)
        sign = np.where(h >> np.uint64(40) & np.uint64(1), 1.0, -1.0)
        hashed = np.bincount(owner * WORD_DIM + (h & np.uint64(WORD_DIM - 1)).astype(np.int64), sign, (j - i) * WORD_DIM).reshape(-1, WORD_DIM)
        x[i:j, PATH_DIM : PATH_DIM + WORD_DIM] = hashed / np.sqrt(np.maximum(n, 1))[:, None]
        x[i:j, -1] = np.log1p(n) / 4
    at = np.concatenate([np.arange(s) for s in sizes]) if len(sizes) else np.zeros(0)
    size = np.maximum(np.repeat(sizes, sizes), 1)
    chars = np.diff(offsets)
    stops = np.array([t.count(".") + t.count(",") + t.count("!") + t.count("?") for t in texts])
    x[:, -6:-1] = np.stack([at / size, 1 - (at + 1) / size, np.log1p(chars) / 7, [v for p in pages for v in p[2]], np.minimum(stops / np.maximum(chars, 1) * 20, 2)], 1)
    return x, sizes


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


class Labeller:
    """A bidirectional LSTM with a logistic output for each step, its gradients and Adam, in numpy."""

    def __init__(self, width: int, hidden: int = HIDDEN, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        new = lambda *s: (rng.standard_normal(s) * 0.3 / np.sqrt(s[0] / 8)).astype(np.float32)
        self.w = {}
        for d in "fb":
            self.w |= {d + "x": new(width, 4 * hidden), d + "h": new(hidden, 4 * hidden), d + "b": np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]).astype(np.float32)}
        self.w |= {"o": new(2 * hidden + width, 1), "ob": np.zeros(1, np.float32)}

    def _pass(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states (pages, steps, hidden) in one direction; what the gradient needs, if keep."""
        n, steps, _ = x.shape
        k = self.hidden
        h, c = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
        out, tape = np.zeros((n, steps, k), np.float32), []
        xw = x @ self.w[d + "x"] + self.w[d + "b"]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = xw[:, t] + h @ self.w[d + "h"]
            s = _sigmoid(z[:, : 3 * k])
            i, f, o, g = s[:, :k], s[:, k : 2 * k], s[:, 2 * k :], np.tanh(z[:, 3 * k :])
            m = mask[:, t, None]
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            if keep:
                tape.append((t, i, f, o, g, c, tc, h, m))
            c = np.where(m, c_new, c)
            h = np.where(m, o * tc, h)
            out[:, t] = h
        return out, tape

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        f, _ = self._pass(x, mask, "f", False)
        b, _ = self._pass(x, mask, "b", False)
        return (np.concatenate([f, b, x], 2) @ self.w["o"] + self.w["ob"])[..., 0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, known: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients. mask: where a page has blocks; known: whose labels count, all by default."""
        k = self.hidden
        known = mask if known is None else known
        f, tf = self._pass(x, mask, "f", True)
        b, tb = self._pass(x, mask, "b", True)
        all_ = np.concatenate([f, b, x], 2)
        p = _sigmoid((all_ @ self.w["o"] + self.w["ob"])[..., 0])
        m = max(known.sum(), 1)
        loss = -float((known * np.log(np.where(y, p, 1 - p) + 1e-9)).sum() / m)
        dz = ((p - y) * known / m)[..., None].astype(np.float32)
        g = {"o": np.einsum("nti,ntj->ij", all_, dz), "ob": dz.sum((0, 1))}
        dall = dz @ self.w["o"].T
        for d, tape, part in (("f", tf, dall[..., :k]), ("b", tb, dall[..., k : 2 * k])):
            dh, dc = np.zeros((len(x), k), np.float32), np.zeros((len(x), k), np.float32)
            gx, gh, gb = np.zeros_like(self.w[d + "x"]), np.zeros_like(self.w[d + "h"]), np.zeros_like(self.w[d + "b"])
            for t, i, fg, o, gg, c, tc, h, mk in reversed(tape):
                dh = dh + part[:, t]
                own = dh * mk
                dcn = (own * o * (1 - tc * tc) + dc * mk)
                dzt = np.concatenate([dcn * gg * i * (1 - i), dcn * c * fg * (1 - fg), own * tc * o * (1 - o), dcn * i * (1 - gg * gg)], 1)
                gx += x[:, t].T @ dzt
                gh += h.T @ dzt
                gb += dzt.sum(0)
                dc = np.where(mk, dcn * fg, dc)
                dh = np.where(mk, dzt @ self.w[d + "h"].T, dh)
            g |= {d + "x": gx, d + "h": gh, d + "b": gb}
        return loss, g

    def train(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray, known: np.ndarray, epochs: int = 10, batch: int = 32, rate: float = 0.01, seed: int = 4) -> float:
        rng = np.random.default_rng(seed)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        m1, m2, step, loss = {k: np.zeros_like(v) for k, v in self.w.items()}, {k: np.zeros_like(v) for k, v in self.w.items()}, 0, 0.0
        pages = np.flatnonzero(sizes)
        for epoch in range(epochs):
            order = pages[np.argsort(sizes[pages] + rng.random(len(pages)) * 6)]
            groups = [order[i : i + batch] for i in range(0, len(order), batch)]
            rng.shuffle(groups)
            for rows in groups:
                xs, mask = pad(x, starts, rows)
                ys, ks = np.zeros(mask.shape, bool), np.zeros(mask.shape, bool)
                ys[mask] = np.concatenate([y[starts[r] : starts[r + 1]] for r in rows])
                ks[mask] = np.concatenate([known[starts[r] : starts[r + 1]] for r in rows])
                loss, g = self.gradients(xs, mask, ys, ks)
                step += 1
                lr = rate * (1 - 0.9 * epoch / epochs)
                for k, v in g.items():
                    v = np.clip(v, -1, 1)
                    m1[k] = 0.9 * m1[k] + 0.1 * v
                    m2[k] = 0.99 * m2[k] + 0.01 * v * v
                    self.w[k] = self.w[k] - (lr * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return loss

    def label(self, x: np.ndarray, sizes: np.ndarray, batch: int = 64) -> np.ndarray:
        """Is each block of the article?"""
        starts = np.concatenate([[0], np.cumsum(sizes)])
        out = np.zeros(len(x), bool)
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > 0]
        i = 0
        while i < len(order):
            rows = order[i : i + batch]
            while len(rows) > 1 and int(sizes[rows[-1]]) * len(rows) > 20_000:
                rows = rows[: len(rows) // 2]
            i += len(rows)
            xs, mask = pad(x, starts, rows)
            z = self.logits(xs, mask)
            for k, r in enumerate(rows):
                out[starts[r] : starts[r + 1]] = z[k, : sizes[r]] > 0
        return out


def pad(x: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    steps = int(max(starts[r + 1] - starts[r] for r in rows))
    xs, mask = np.zeros((len(rows), steps, x.shape[1]), np.float32), np.zeros((len(rows), steps), bool)
    for k, r in enumerate(rows):
        n = starts[r + 1] - starts[r]
        xs[k, :n], mask[k, :n] = x[starts[r] : starts[r + 1]], True
    return xs, mask


_ENDINGS = (("ing", "er", "ed", "an", "th", "on"), ("ung", "keit", "en", "lich", "ß", "ü"), ("tion", "eux", "é", "è", "ent", "que"), ("ción", "os", "ad", "ñ", "aba", "ía"), ("の", "は", "本", "日", "語", "文"), ("ый", "ть", "ние", "ов", "ах", "я"))


def generated_page(rng: random.Random) -> tuple[str, list[bool]]:
    """A page of a random layout and language, and the label of each of its blocks."""
    endings = rng.choice(_ENDINGS)
    vocabulary = [chr(97 + i % 26) + chr(97 + i * 7 % 26) + chr(97 + i * 11 % 26) * (i % 3) + endings[i % 6] for i in range(300)]
    word = lambda: rng.choice(vocabulary)
    sentence = lambda n=None: " ".join(word() for _ in range(n or rng.randint(4, 22))).capitalize() + rng.choice(". . . ! ?".split())
    prose = lambda: " ".join(sentence() for _ in range(rng.choice([1, 1, 2, 4, 7])))
    plain = lambda: "".join(rng.choices("bcdfghjklmnprstvwz", k=1) + rng.choices("aeiou", k=1) + rng.choices("bcdfghjklmnprstvwz", k=rng.randint(1, 2)))  # noqa: E731  a name that says nothing
    named = rng.random() < 0.85  # do class names of this page mean anything?

    def block(tag: str, inside: str, cls: str = "", key: str = "") -> str:
        return f"<{tag}{f' {key or rng.choice(["class", "class", "id"])}="{cls}"' if cls else ''}>{inside}</{tag}>"

    def items(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(n)) + "</ul>" if rng.random() < 0.7 else "".join(f'<a href="/{word()}">{word()}</a> ' for _ in range(n))

    def away_name() -> str:
        return (rng.choice(sorted(AWAY_WORDS)) if rng.random() < 0.7 else rng.choice(AWAY_ABROAD)) + rng.choice(["", "", "-box", " inner", "-1", "_" + plain(), " " + plain()])

    def comments() -> str:
        cls = rng.choice(["comment", "comments", "reply", "replies", "disqus", "kommentar", "kommentare", "commentaires", "comentarios", "respond", "discussion"]) + rng.choice(["", "_thread", "-list", "s", " " + plain()])
        one = rng.choice([lambda: f"<b>{word()}</b> {rng.randint(1, 28)}.{rng.randint(1, 12)}.2021<p>{prose()}</p>", lambda: prose(), lambda: f'<a href="/u/{word()}">{word()}</a><div>{prose()}</div>'])
        outer, inner = rng.choice([("ol", "li"), ("ul", "li"), ("div", "div"), ("section", "article"), ("section", "div")])
        body = "".join(f"<{inner}>{one()}</{inner}>" for _ in range(rng.randint(1, 6)))
        return block(outer, (f"<h3>{sentence(2)}</h3>" if rng.random() < 0.5 else "") + body, cls)

    def away_part() -> str:
        if rng.random() < 0.25:
            return comments()
        kind = rng.choice(["nav", "div", "aside", "form", "section", "ul", "div", "p"])
        links = lambda: items(rng.randint(2, 8))
        if not named and kind not in ("nav", "aside", "form"):  # nothing but the wording tells these
            return block("div", rng.choice([links, links, lambda: sentence(3), lambda: f"&copy; {rng.randint(1999, 2025)} {word()}"])(), plain())
        inner = rng.choice([links, lambda: block("p", prose()), sentence, lambda: block("h3", word()) + items(3), lambda: block("div", prose()) + block("div", prose())])()
        if kind == "ul":
            return block("ul", "".join(f"<li>{sentence(3)}</li>" for _ in range(rng.randint(1, 5))), away_name())
        if kind in ("nav", "aside", "form"):
            return block(kind, inner, rng.choice(["", away_name()]))
        return block(kind, inner if kind != "p" else sentence(), away_name())

    def article() -> str:
        body = [block(rng.choice(["h1", "h1", "h2"]), sentence(rng.randint(2, 9)))] if rng.random() < 0.6 else []
        for _ in range(rng.choice([0, 1, 1, 2, *range(2, 15)]) or 1 - len(body)):
            body.append(rng.choice([lambda: block("p", prose()), lambda: block("p", prose()), lambda: f"<p><b>{prose()}<br><p>{prose()}</p>", lambda: block("h2", sentence(3)), lambda: "<ul>" + "".join(block("li", sentence()) for _ in range(3)) + "</ul>", lambda: block("blockquote", prose()), lambda: block("p", f"{sentence()} <a href=x>{word()} {word()}</a> {sentence()}"), lambda: "<table><tr><td>" + word() + "<td>" + sentence(4) + "</table>", lambda: block("p", sentence(rng.randint(1, 3))), lambda: block("div", prose())])())
            if rng.random() < 0.08:
                body.append("\0" + away_part() + "\0")
        inner = "".join(body)
        name = lambda: (rng.choice(MAIN_WORDS) if named else plain()) + rng.choice(["", "", "-" + plain(), " " + plain(), "-1"])
        return rng.choice([lambda: block("article", inner), lambda: block("main", inner), lambda: block("main", block("article", inner)), lambda: block("div", inner, name()), lambda: block("div", inner, name()), lambda: block("div", block("div", inner, name()), plain()), lambda: block("div", inner), lambda: inner])()

    parts = [(away_part(), False) for _ in range(rng.randint(0, 4))]
    if rng.random() < 0.5:
        parts.insert(0, (block("header", rng.choice([items(4), block("h1", word()), sentence(3)])), False))
    if rng.random() < 0.95:
        parts.append((article(), True))
    parts += [(away_part(), False) for _ in range(rng.randint(0, 4))]
    if rng.random() < 0.7:
        parts.append((block("footer", rng.choice([f"&copy; {word()} &middot; {prose()}", items(3), block("p", sentence())])), False))
    wrap = rng.random() < 0.3
    out: list[str] = []
    labels: list[bool] = []
    for text, good in parts:
        pieces = text.split("\0")
        out.append("".join(pieces))
        if good and len(pieces) > 1:
            marked = "".join(p if i % 2 == 0 else f'<i class="zz">{p}</i>' for i, p in enumerate(pieces))
            labels += [".zz" not in q for q in blocks(marked)[0]]
        else:
            labels += [good] * len(blocks(text)[0])
    page = "<!DOCTYPE html><html><head><title>x</title></head><body>" + (f'<div class="{plain()}">' if wrap else "") + "".join(out) + ("</div>" if wrap else "") + "</body></html>"
    return page, labels


def said(path: tuple[str, ...]) -> bool | None:
    """What the markup says outright of a block: of the article, not of it, or nothing."""
    return False if away(path) else True if "article" in path or "main" in path else None


def windows(page: tuple[list, list[str], list[float]]) -> Iterator[tuple[list, list[str], list[float]]]:
    for i in range(0, len(page[0]), WINDOW):
        yield tuple(part[i : i + WINDOW] for part in page)


def train(sample: list[str], generated: int = GENERATED, seed: int = 5) -> Labeller:
    """A labeller from generated pages and the sampled ones."""
    rng = random.Random(seed)
    pages, labels = [], []
    for _ in range(generated):
        page, own = generated_page(rng)
        found = leaves(page)
        if len(found[0]) == len(own):
            pages.append(found)
            labels += own
    for page in sample:
        for found in windows(leaves(page)):
            pages.append(found)
            labels += [said(p.all() if p else ()) for p in found[0]]
    x, sizes = vectors(pages)
    model = Labeller(x.shape[1])
    model.train(x, sizes, np.array([v is True for v in labels], bool), np.array([v is not None for v in labels], bool))
    return model


def extract(htmls: list[str | None], model: Labeller) -> list[str]:
    pages = [leaves(h or "") for h in htmls]
    x, sizes = vectors(pages)
    keep = model.label(x, sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    return [" ".join(t for t, k in zip(p[1], keep[starts[i] : starts[i + 1]], strict=True) if k) for i, p in enumerate(pages)]


def sampled(pages: DataFrame, sample: int = SAMPLE, most: int = SAMPLE_BYTES) -> list[str]:
    """The pages to learn from: the least by a hash of page_id, of pages that repeat an id the least by digest; one that
    doesn't fit into what is left of `most` bytes is passed over."""
    rows = pages.where(F.col("html").isNotNull()).select("page_id", F.xxhash64("html").alias("digest"), "html")
    least = F.min(F.struct("digest", F.octet_length("html").alias("size"))).alias("least")
    ids = rows.groupBy("page_id").agg(least).select("page_id", "least.*", F.xxhash64(F.col("page_id").cast("string"), F.lit(8)).alias("h"))
    chosen = []
    for r in ids.orderBy("h", "page_id").limit(sample).collect():
        if r["size"] <= most:
            most -= r["size"]
            chosen.append((r["page_id"], r["digest"], r["h"]))
    if not chosen:
        return []
    wanted = F.broadcast(pages.sparkSession.createDataFrame(chosen, f"id {pages.schema['page_id'].dataType.simpleString()}, d long, h long"))  # at most `sample` rows
    found = rows.join(wanted, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d"))).groupBy("h", "digest").agg(F.first("html").alias("html"))
    return [r["html"] for r in sorted(found.collect(), key=lambda r: (r["h"], r["digest"]))]


def extract_text(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, url, text, n_chars for each page."""
    spark = pages.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(train(sampled(pages, sample)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for i in range(0, x.num_rows, 256):
                part = x.slice(i, 256)
                texts = extract(part.column(2).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string"), "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; see the module's text."""
    return extract_text(read(spark, sf_dir, "pages"))
