"""Template residue, filler, error pages and scripts-required notices that stand in place of content.

Texts are cut into paragraphs outside code. Weak labels from phrases, response statuses and shape
train a regularised linear classifier on hashed n-grams, length and title features, fitted on a
bounded hash sample of documents; rows that the labels call content and a first fit doesn't are left
out of the second. Every paragraph of every document is scored, a batch at a time: a token's share
of the sum is looked up, those of its pairs and triples are gathered by hash. The validation holds
back sources, and it holds back phrases: what only they would have labelled must still be found.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Documents of the training sample at most (about), hashed features, L2 weight, steps.
TRAIN_DOCS, WIDTH, L2, STEPS = 30_000, 1 << 17, 3e-5, 80
#: A paragraph scored from here on is residue; content that a first fit scores so is doubtful. Parts that sources and phrases are held back in.
BAR, DOUBT, FOLDS = 0.5, 0.3, 3

# Phrases of notices, error pages and filler in the languages of the corpus.
SCRIPTS = r"java ?script|\bjs\b|noscript|scripts?\b|scripting"
NEEDED = r"enable|disabled|turn it on|switch(ed)? (it )?on|allow it|requires?|needs?|need|without|activ|ative |aktiv|necesita|desactivado|precisa|desativado|désactivé|включите|нужен|требуется|отключ|benötigt|blocked|activer"
ERRORS = r"""
(error|err\.|fehler|erreur|erro|ошибка|http|status|code)\W{0,5}[45]\d\d\b|\b[45]\d\d\W{0,5}(not found|forbidden|bad gateway|gateway time|service unav|internal|unauthorized|too many)|not found|introuvable|nicht gefunden|no encontrada|no se encontró|não encontrada|не найдена|bad gateway|gateway time-?out|service is unavailable|forbidden|access denied|zugriff verweigert|acceso denegado|accès refusé|acesso negado|доступ запрещ
error establishing|database connection|\boops\b|\bwhoops\b|something went wrong|unerwarteter fehler|error inesperado|erreur inattendue|erro inesperado|произошла ошибка|too many requests|zu viele anfragen|demasiadas solicitudes|trop de requêtes|muitas solicitações|слишком много запросов|session has expired|login has expired|sitzung ist abgelaufen|sesión ha caducado|session a expiré|sessão expirou|сессия истекла
checking your browser|could not be (found|located)|internal server error|interner serverfehler|erreur interne|error interno|erro interno|внутренняя ошибка|no longer available|fatal error|uncaught|maintenance|wartungsarbeiten|mantenimiento|manutenção|технические работы|unavailable|indisponible|no disponible|nicht verfügbar|nicht erreichbar|indisponível|недоступ|"status": ?[45]\d\d|http err(or|\.)? ?[45]\d\d|try again in \d|sign in again|view this page
"""
FILLER = r"todo:|tbd\b|lorem ipsum|goes here|text here|type your|your (question|answer|text|title) here|edit this (template|page|section)|write this section|coming soon|under construction|to be added|dummy|placeholder|blindtext|platzhalter|beispieltext|texto de relleno|texto provis|texte provisoire|faux texte|заполнител|заглушк|текст-рыба|sample text|insert .{1,30} here"
LATIN = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua urna vitae felis nulla justo porta velit odio risus nunc enim minim veniam quis nostrud"
PLACEHOLDERS = r"\{ ?\{[^{}]*\} ?\}|\{%[^%]*%\}|<%=?[^%]*%>|\$\{(?!home\})[\w.]+\}|#\{[\w.]+\}|%\([\w.]+\)[sd]|%[a-z][a-z_]+%|@@\w+@@|__[a-z][a-z_]*[a-z]__|\[\[[\w. ]+\]\]|\[insert [^\]]*\]|<<[\w. ]+>>|<your [^>]*>|<[a-z]+_[a-z_]+>|<(?:title|body|date|topic|company|product|answer|question|name|author|user|email|subject)>|\[object object\]|\{[a-z]+_[a-z_]+\}|\[your [^\]]*\]"

# Words by which a single writer speaks of themselves; notices say we, if anything.
SELF = frozenset("i my me ich mein meine meinem meiner je mon ma mes yo mi mis eu meu minha я мой моя мне меня".split())


def _parts(pattern: str) -> list[str]:
    """The alternatives of a pattern outside brackets."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(pattern):
        depth += (c in "([") - (c in ")]")
        if c == "|" and not depth:
            out.append(pattern[at:i])
            at = i + 1
    return [*out, pattern[at:]]


_FENCE = re.compile(r"```|(?m:^[ \t]*~~~)")
_PRE = re.compile(r"<(pre|code|script|style)\b.*?</\1\s*>", re.S | re.I)
_PRE_OPEN = re.compile(r"<(?:pre|code|script|style)\b.*?(?:\n[^\S\n]*\n|\Z)", re.S | re.I)
_BLANK = re.compile(r"\n[^\S\n]*\n")
_TICKS = re.compile(r"`[^`\n]+`")
_SAID = re.compile(r"[“„«\"][^”“»\"\n]{3,}[”“»\"]")
_TAGS = re.compile(r"</?(?:html|head|body|title|h[1-6]|p|br|hr|div|span|b|i|u|em|strong|a|ul|ol|li|table|tr|td|th|tbody|thead|center|font|meta|link|img|blockquote|sup|sub|small)\b[^<>]*>", re.I)
_SCRIPTS, _NEEDED = re.compile(SCRIPTS), re.compile(NEEDED)
_CUES = [re.compile("|".join(x)) for x in [[p for line in [*ERRORS.strip().split("\n"), FILLER] for p in _parts(line) if zlib.crc32(p.encode()) % FOLDS == fold] for fold in range(FOLDS)]]
_PLACEHOLDER = re.compile(PLACEHOLDERS, re.I | re.S)
_LATIN = frozenset(LATIN.split())
_URL = re.compile(r"https?://\S+|\b[\w-]+(?:\.[\w-]+)*\.(?:invalid|test|example|com|org|net|io|local)\b", re.I)
_HEX = re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{6,40}\b")
_WORD = re.compile(r"[^\W\d_]+|\d+|[?!…]|@\w+@")
_DIGITS = re.compile(r"\d+")
_FORMAT = re.compile("[\u00ad\u0600-\u0605\u061c\u06dd\u070f\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufeff\ufff9-\ufffb]")
_SLOT_SIGNS, _QUOTES = re.compile(r"[{}<%$#@\[]|__"), re.compile("[“„«\"]")
_JSON = re.compile(r"\{\s*\"[\w ]+\"\s*:")
_CUE_WORDS = frozenset(re.findall(r"[^\W\d_]{5,}", f"{ERRORS} {FILLER} {NEEDED}"))
_QUOTE_BLOCK = re.compile(r"^\s*>")


def _unfenced(text: str) -> str:
    """Text without what stands between fence marks, paired in order; an open fence ends at the next blank line."""
    marks = [(m.start(), m.end(), m.group().lstrip()) for m in _FENCE.finditer(text)]
    out, at, i = [], 0, 0
    while i < len(marks):
        start, end, kind = marks[i]
        j = next((j for j in range(i + 1, len(marks)) if marks[j][2] == kind), None)
        if j is None:
            blank = _BLANK.search(text, end)
            stop, i = blank.start() if blank else len(text), i + 1
        else:
            stop, i = marks[j][1], j + 1
        if start >= at:
            out += [text[at:start], "\n\n"]
            at = stop
    return "".join([*out, text[at:]])


def paragraphs(text: str) -> list[str]:
    """Paragraphs outside code: fenced and preformatted blocks and indented lines are left out, ticked code becomes a stand-in."""
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\u2028", "\n").replace("\u2029", "\n\n")
    if "```" in text or "~~~" in text:
        text = _unfenced(text)
    if "`" in text:
        text = _TICKS.sub(" @code@ ", text)
    if "<" in text and (low := text.lower()) and any(f"<{t}" in low for t in ("pre", "code", "script", "style")):
        text = _PRE_OPEN.sub("\n\n", _PRE.sub("\n\n", text))
    out = []
    for block in _BLANK.split(text):
        if "\n" not in block:
            if block.strip() and not block.startswith(("    ", "\t")) and not _QUOTE_BLOCK.match(block):
                out.append(block)
            continue
        lines = [x for x in block.split("\n") if x.strip() and not x.startswith(("    ", "\t"))]
        if not lines or all(_QUOTE_BLOCK.match(x) for x in lines):  # quoted from elsewhere
            continue
        out.append("\n".join(lines))
    return out


def plain(paragraph: str) -> str:
    """Lower-case text of a paragraph with stand-ins for placeholders, code, quotations, addresses and ids."""
    p = paragraph
    if not p.isascii():
        p = unicodedata.normalize("NFKC", p)
        p = _FORMAT.sub("", p)
    if "<" in p:
        p = _TAGS.sub(" ", p)
    p = html.unescape(p) if "&" in p else p
    if _SLOT_SIGNS.search(p):
        p = _PLACEHOLDER.sub(" @slot@ ", p)
    p = p.lower()
    if _QUOTES.search(p) and not _JSON.search(p):
        p = _SAID.sub(" @said@ ", p)
    if "." in p:
        p = _URL.sub(" @host@ ", p)
    if _DIGITS.search(p):
        p = _HEX.sub(" @id@ ", p)
    return " ".join(p.split())


def weak_label(p: str, tokens: list[str], bad_status: bool) -> tuple[int, int]:
    """1 residue, 0 content, -1 undecided, from phrases, response status and shape; and the bits of the phrase parts that the label rests on."""
    words = [t for t in tokens if t[0].isalpha()]
    slots = p.count("@slot@")
    talk = "@said@" in p or "@code@" in p or "?" in p or p.endswith(":") or not SELF.isdisjoint(words)
    if len(tokens) >= 4 and len(set(tokens)) == 1 and not p.startswith(("- ", "* ")):
        return 1, 0
    if len(words) >= 6 and sum(w in _LATIN for w in words) >= 0.7 * len(words):
        return 1, 0
    if slots:
        if talk:
            return 0, 0
        return (1 if len(words) <= 12 * slots and "each" not in words else -1), 0
    folds = sum(1 << k for k, cue in enumerate(_CUES) if cue.search(p))
    scripts = bool(_SCRIPTS.search(p) and _NEEDED.search(p))
    if not folds and not scripts or talk:
        return 0, 0
    if len(words) <= 22 or bad_status and len(words) <= 40:
        return 1, 0 if scripts else folds
    return -1, 0


def _mixed(*parts: np.ndarray) -> np.ndarray:
    """Feature numbers of sequences of token hashes."""
    out = np.zeros(len(parts[0]), np.uint64)
    with np.errstate(over="ignore"):
        for x in parts:
            out = (out ^ x) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
    return (out % np.uint64(WIDTH)).astype(np.int64)


class Words:
    """Tokens seen so far by number: hash and features (the word and its pieces). Ends of paragraphs are tokens 0 and 1."""

    LIMIT = 400_000

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.hashes, self.pieces = [], []
        for t in ("^", "$"):
            self(t)
        self.pieces[0] = self.pieces[1] = np.zeros(0, np.int64)

    def __call__(self, t: str) -> int:
        n = self.number.get(t)
        if n is None:
            n = self.number[t] = len(self.hashes)
            b = f"<{t}>".encode()
            h = zlib.crc32
            own = h(b)
            self.hashes.append(own * 0x1000193 + len(b))
            self.pieces.append(np.array([own, *([h(b"c" + b[i : i + 5]) for i in range(max(1, len(b) - 4))] if len(t) > 3 else [])], np.int64) % WIDTH)
        return n


@dataclass
class Batch:
    """Paragraphs of a batch of texts: text, tokens, document, place in it and the document's number of paragraphs; token numbers between ends; shape features."""

    plain: list[str]
    tokens: list[list[str]]
    doc: np.ndarray
    place: np.ndarray
    total: np.ndarray
    flat: np.ndarray
    begin: np.ndarray
    shape: np.ndarray

    def grams(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Features of pairs and of triples of tokens, each with its paragraph."""
        h = np.array(words.hashes, np.uint64)[self.flat]
        last = np.append(self.begin[1:], len(self.flat)) - 1
        inner = np.ones(len(h), bool)
        inner[last] = False
        two = np.flatnonzero(inner)
        inner[last - 1] = False
        three = np.flatnonzero(inner)
        own = np.repeat(np.arange(len(self.begin)), np.diff(np.append(self.begin, len(self.flat))))
        return _mixed(h[two], h[two + 1]), own[two], _mixed(h[three], h[three + 1], h[three + 2]), own[three]


def _shape(p: str, tokens: list[str], n_paragraphs: int, title_words: set[str], bad: bool) -> list[int]:
    n, distinct = len(tokens), set(tokens)
    same = len(title_words & distinct) / len(title_words) if title_words else -1
    marks = (f"#len{min(9, n.bit_length())}", f"#only{min(3, n_paragraphs)}", f"#distinct{int(len(distinct) / n * 5) if n else 0}{n > 6}", f"#title{int(same * 4)}", f"#latin{int(sum(t in _LATIN for t in tokens) / max(1, n) * 5)}", f"#slots{min(3, p.count('@slot@'))}{n > 14}", f"#ask{'?' in p}", f"#said{'@said@' in p or '@code@' in p}", f"#sentences{min(4, p.count('. '))}", f"#status{bad}", f"#self{not SELF.isdisjoint(distinct)}", f"#leads{p.endswith(':')}")
    return [zlib.crc32(m.encode()) % WIDTH for m in marks]


def read(texts: list[str | None], titles: list[str | None], bads: list[bool], words: Words) -> Batch:
    """The paragraphs of a batch that have words, placeholders or an ellipsis."""
    if len(words.hashes) > Words.LIMIT:
        words.clear()
    out, tokens, doc, place, total, flat, begin, shape = [], [], [], [], [], [], [], []
    for d, (text, title, bad) in enumerate(zip(texts, titles, bads)):
        parts = paragraphs(text or "")
        known = set(_WORD.findall(title.lower())) if title and parts else set()
        first = len(out)
        for part in parts:
            p = plain(part)
            got = _WORD.findall(_DIGITS.sub("0", p))
            if not ("{" in p or any(t[0].isalpha() or t == "@slot@" or t == "…" for t in got)):
                continue
            begin.append(len(flat))
            flat.append(0)
            flat += map(words, got)
            flat.append(1)
            place.append(len(out) - first)
            out.append(p)
            tokens.append(got)
            doc.append(d)
            shape.append(_shape(p, got, len(parts), known, bool(bad)))
        total += [len(out) - first] * (len(out) - first)
    ints = lambda x: np.array(x, np.int64)
    return Batch(out, tokens, ints(doc), ints(place), ints(total), ints(flat), ints(begin), ints(shape).reshape(len(out), -1))


@dataclass
class Model:
    """Weights of the hashed features and what the validation gave."""

    weights: np.ndarray
    bias: float
    report: dict[str, float]

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        """Of rows of features."""
        size = np.array([len(r) for r in rows])
        sums = np.add.reduceat(self.weights[np.concatenate(rows)], np.append(0, np.cumsum(size)[:-1])) if len(rows) else np.zeros(0)
        return 1 / (1 + np.exp(-sums / np.sqrt(size) - self.bias))

    def score_batch(self, batch: Batch, words: Words, known: list[np.ndarray]) -> np.ndarray:
        """Of a batch's paragraphs; known holds the sums and sizes of the tokens scored before."""
        if not len(batch.begin):
            return np.zeros(0)
        have = len(known[0]) if len(known[0]) <= len(words.pieces) else 0
        fresh = words.pieces[have:]
        sums = np.array([self.weights[f].sum() for f in fresh])
        known[0] = np.append(known[0][:have], sums)
        known[1] = np.append(known[1][:have], [len(f) for f in fresh])
        two, own_two, three, own_three = batch.grams(words)
        n = len(batch.begin)
        z = np.add.reduceat(known[0][batch.flat], batch.begin) + np.bincount(own_two, self.weights[two], n) + np.bincount(own_three, self.weights[three], n) + self.weights[batch.shape].sum(1)
        size = np.add.reduceat(known[1][batch.flat], batch.begin) + np.bincount(own_two, minlength=n) + np.bincount(own_three, minlength=n) + batch.shape.shape[1]
        return 1 / (1 + np.exp(-z / np.sqrt(size) - self.bias))


def fit(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression by accelerated gradient steps, classes weighted evenly."""
    size = np.array([len(r) for r in rows])
    cols, at = np.concatenate(rows), np.repeat(np.arange(len(rows)), size)
    begin = np.append(0, np.cumsum(size)[:-1])
    used, cols = np.unique(cols, return_inverse=True)
    scale = 1 / np.sqrt(size)
    positive = max(1, labels.sum())
    weight = np.where(labels == 1, 0.5 / positive, 0.5 / max(1, len(labels) - positive))
    w, bias = np.zeros(len(used)), 0.0
    mw, mb = w.copy(), bias
    for step in range(STEPS):
        z = np.add.reduceat(mw[cols], begin) * scale + mb
        g = (1 / (1 + np.exp(-z)) - labels) * weight
        grad = np.bincount(cols, (g * scale)[at], len(used)) + L2 * mw
        nw, nb = mw - 12 * grad, mb - 2 * g.sum()
        pace = step / (step + 3)
        mw, mb = nw + pace * (nw - w), nb + pace * (nb - bias)
        w, bias = nw, nb
    out = np.zeros(WIDTH)
    out[used] = w
    return out, bias


def _twice(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Fitted again without the rows called content that a first fit doubts: residue that no phrase names."""
    first = Model(*fit(rows, labels), {})
    keep = (labels == 1) | (first.score(rows) < DOUBT)
    return fit([r for r, k in zip(rows, keep) if k], labels[keep])


def labelled(docs: DataFrame, max_docs: int = TRAIN_DOCS) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, int]:
    """Features, weak labels, sources and phrase bits of paragraphs of a hash sample of about max_docs documents, and the number of all."""
    total = docs.count()
    share = min(1.0, max_docs / max(1, total))
    sample = docs if share == 1 else docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < int(share * (1 << 20)))
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("label", T.IntegerType()), T.StructField("folds", T.IntegerType()), T.StructField("features", T.ArrayType(T.IntegerType()))])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            doc, text, title, source, bad = (c.to_pylist() for c in batch.columns)
            got = read(text, title, bad, words)
            out, picked = [], []
            for i, (p, tokens) in enumerate(zip(got.plain, got.tokens)):
                d = got.doc[i]
                # Of plain content a fixed share by hash is enough; what is long can't be residue by phrase alone.
                lot = zlib.crc32(f"{doc[d]} {got.place[i]}".encode())
                if len(tokens) > 60 and lot % 16 and "@slot@" not in p and tokens[0] not in _LATIN:
                    continue
                y, folds = weak_label(p, tokens, bool(bad[d]))
                hard = y == 0 and ("@said@" in p or "@code@" in p or len(tokens) <= 8 or _SCRIPTS.search(p) or not _CUE_WORDS.isdisjoint(tokens))
                if y == 1 or y == 0 and lot % (2 if hard else 16) == 0:
                    out.append((source[d], y, folds))
                    picked.append(i)
            rows = []
            if picked:
                two, own_two, three, own_three = got.grams(words)
                ends = np.append(got.begin, len(got.flat))
                spans = [(np.searchsorted(own, picked), np.searchsorted(own, picked, side="right")) for own in (own_two, own_three)]
                for k, i in enumerate(picked):
                    rows.append(np.concatenate([*[words.pieces[t] for t in got.flat[ends[i] : ends[i + 1]]], two[spans[0][0][k] : spans[0][1][k]], three[spans[1][0][k] : spans[1][1][k]], got.shape[i]]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), *[pa.array([o[j] for o in out], pa.int32()) for j in (1, 2)], pa.array(rows, pa.list_(pa.int32()))], names=schema.names)

    got = sample.select("doc_id", "text", "title", "source", "bad").mapInArrow(label, schema).toArrow().combine_chunks()
    rows = [np.asarray(x, np.int64) for x in got.column("features").to_numpy()] if got.num_rows else []
    sources = np.array([zlib.crc32((s or "").encode()) for s in got.column("source").to_pylist()], np.int64)
    return rows, got.column("label").to_numpy().astype(np.float64), sources, got.column("folds").to_numpy(), total


def train(docs: DataFrame, max_docs: int = TRAIN_DOCS, validate: bool = False) -> Model:
    """Fit on a hash sample of about max_docs documents (doc_id, text, title, source, bad).

    With validate the report tells how a fit does on sources it hasn't seen (each of FOLDS parts of
    them in turn), and on rows that only the phrases held back would have labelled.
    """
    rows, labels, sources, folds, total = labelled(docs, max_docs)
    report = {"documents": float(total), "rows": float(len(rows)), "positives": float(labels.sum())}
    if not labels.any() or labels.all():
        return Model(np.zeros(WIDTH), -9.0, report)

    def check(inside: np.ndarray, test: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        if not test.any() or not labels[inside].any() or labels[inside].all():
            return None
        m = Model(*_twice([r for r, k in zip(rows, inside) if k], labels[inside]), {})
        return m.score([r for r, k in zip(rows, test) if k]) >= BAR, labels[test] == 1

    if validate:
        for name, parts in (("unseen", [(part, part) for part in (sources % FOLDS == k for k in range(FOLDS))]), ("held_back", [(folds & (1 << k) > 0, folds == 1 << k) for k in range(FOLDS)])):
            got = [g for hidden, test in parts if (g := check(~hidden, test))]
            said, true = (np.concatenate([g[i] for g in got]) if got else np.zeros(0, bool) for i in (0, 1))
            report |= {f"{name}_rows": float(len(said)), f"{name}_recall": float((said & true).sum() / max(1, true.sum()))}
            if name == "unseen":
                report["unseen_precision"] = float((said & true).sum() / max(1, said.sum()))
    return Model(*_twice(rows, labels), report)


def prepared(docs: DataFrame, doc_id: str, text: str, title: str, source: str, links: str | None) -> DataFrame:
    """doc_id, text, title, source, bad: bad if a link of the document answered with an error."""
    bad = F.coalesce(F.exists(links, lambda x: (x["http_status"] == 0) | (x["http_status"] >= 400)), F.lit(False)) if links else F.lit(False)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(title).cast("string").alias("title"), F.col(source).cast("string").alias("source"), bad.alias("bad")).filter("doc_id is not null and text is not null")


def residue_paragraphs(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, paragraph, score, whole of the paragraphs scored BAR or more; docs as from prepared().

    Null, empty and blank texts have no paragraphs and give no row; a text without a blank line is
    one paragraph; code, preformatted text and quoted blocks are no paragraphs; whole tells that the
    document has no other paragraph; a doc_id that comes twice is judged twice.
    """
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("paragraph", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("whole", T.BooleanType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = Words(), [np.zeros(0), np.zeros(0)]
        for batch in batches:
            doc, text, title, bad = (c.to_pylist() for c in batch.columns)
            for s in range(0, len(doc), 1000):
                got = read(text[s : s + 1000], title[s : s + 1000], bad[s : s + 1000], words)
                score = model.score_batch(got, words, known)
                hit = np.flatnonzero(score >= BAR)
                yield pa.RecordBatch.from_arrays([pa.array([doc[s + d] for d in got.doc[hit]], pa.int64()), pa.array(got.place[hit].astype(np.int32)), pa.array(score[hit]), pa.array(got.total[hit] == 1)], names=schema.names)

    return docs.select("doc_id", "text", "title", "bad").mapInArrow(judge, schema)
