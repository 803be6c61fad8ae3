"""Personal data: fixed patterns, and a skip-chain CRF that carries their labels to repeated and similar tokens."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.llm.shared import pieces, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: Labels of the field: 0 for none, then KINDS.
LABELS = len(KINDS) + 1
#: Values of shape(): digits, "@", dots, other marks, letters.
SHAPES = 6 * 2 * 4 * 2 * 2
#: Characters that a key needs, digits that a key of digits needs: shorter tokens repeat by chance.
KEY_CHARS, KEY_DIGITS = 6, 7
#: Belief that a token needs to be marked.
BELIEF = 0.75

# An e-mail address is looked for around each "@": the run before it is maximal, so its start is the leftmost.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# The other patterns, with possessive runs: same matches, linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
#: A local part that has none of these is a word like any other (support@, editor@): its uses elsewhere say nothing.
_NAMED = re.compile(r"[0-9._%+]")
#: Words that say of a bare number after them that it is something else than a phone or card number.
_THINGS = frozenset(
    "part parts order orders item items article product model serial sku lot batch invoice ticket case ref reference id isbn version "
    "teil artikel bestellung auftrag rechnung produkt modell referenz vorgang "
    "pieza pedido articulo artículo producto modelo factura referencia lote serie "
    "pièce commande article produit modèle facture référence lot série".split()
)
#: Log odds against a label that such a word gives.
NAMED_THING = 12.0
_EDGE = "\"'.,;:!?()[]{}<>|"

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(int(d) * 2 - 9 * (d > "4") for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, m.end()))
            end = m.end()
        else:
            end = max(end, at + 1)  # nothing before this "@" can start a later match
        at = text.find("@", max(end, at + 1))
    return out


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) by kind, then start; code points, end exclusive."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((1, *m.span()))
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append((3, *m.span()))
    return out


def shape(token: str) -> int:
    """What a token looks like, coarsely."""
    digits = len(_NOT_DIGIT.sub("", token))
    kind = 0 if not digits else 1 if digits < 4 else 2 if digits < 7 else 3 if digits < 9 else 4 if digits < 13 else 5
    return (((kind * 2 + ("@" in token)) * 4 + min(3, token.count("."))) * 2 + any(c in token for c in "-()+")) * 2 + any(
        map(str.isalpha, token)
    )


def keys(token: str) -> list[str]:
    """Tokens with a key in common are repeated or similar: the text, an address's local part, the digits alone.

    A local part of letters only is no key: it may be any word, and nothing in the document tells its uses from a name's.
    """
    low = token.lower()
    out = [low] if len(low) >= KEY_CHARS else []
    if "@" in low and len(local := low.partition("@")[0]) >= KEY_CHARS and _NAMED.search(local):
        out.append(local)
    digits = _NOT_DIGIT.sub("", low)
    if len(digits) >= KEY_DIGITS and digits != low and not any(map(str.isalpha, low)):
        out.append(digits)
    return out


def _says_thing(text: str, before: tuple[int, int, int, int], token: tuple[int, int, int, int]) -> bool:
    """Whether the token just before is a word of _THINGS, as in "order no. 17", "Part #17" and "part 17"."""
    words = re.findall(r"[^\W\d_]+", text[max(0, before[0] - 24) : token[0]].lower())
    if words and words[-1] in ("no", "nr", "num", "number", "nummer", "número", "numéro"):
        words.pop()
    return bool(words) and words[-1] in _THINGS


class Field:
    """The tokens of a text that its entities reach: tokens of base spans, and tokens that share a key with one."""

    def __init__(self, text: str, base: list[Span]):
        spans = sorted((a, b, k + 1) for k, a, b in base)
        tokens, at = [], 0  # (start, end, label, index)
        for i, m in enumerate(_TOKEN.finditer(text)):
            a, b = m.span()
            while at < len(spans) and spans[at][1] <= a:
                at += 1
            near, label = at, 0  # spans of different kinds may overlap: the first that the token meets counts
            while not label and near < len(spans) and spans[near][0] < b:
                label = spans[near][2] if a < spans[near][1] else 0
                near += 1
            if not label:
                a += len(m[0]) - len(m[0].lstrip(_EDGE))
                b -= len(m[0]) - len(m[0].rstrip(_EDGE)) if a < b else 0
            if a < b:
                tokens.append((a, b, label, i))
        # a phone number's tokens stand for the whole number, too
        by_key: dict[str, list[int]] = {}
        for n, (a, b, label, _) in enumerate(tokens):
            for key in keys(text[a:b]):
                by_key.setdefault(key, []).append(n)
        ends = [t[1] for t in tokens]
        for a, b, label in spans:
            if label > 1:
                whole = _NOT_DIGIT.sub("", text[a:b])
                for key in {whole, whole[-10:]} if label == 4 else {whole}:
                    by_key.setdefault(key, []).append(bisect_right(ends, a))  # the span's first token
        groups = [sorted(set(g)) for g in by_key.values() if len(set(g)) > 1 and any(tokens[n][2] for n in g)]
        self.entity = [n for n, t in enumerate(tokens) if t[2]]
        kept = sorted({n for g in groups for n in g} | set(self.entity))
        number = {n: k for k, n in enumerate(kept)}
        self.tokens = [tokens[n] for n in kept]
        self.shapes = np.array([shape(text[t[0] : t[1]]) for t in self.tokens], int)
        self.labels = np.array([t[2] for t in self.tokens], int)
        #: tokens without a letter whose word before names a thing
        self.things = np.array([bool(n) and not any(map(str.isalpha, text[tokens[n][0] : tokens[n][1]])) and _says_thing(text, tokens[n - 1], tokens[n]) for n in kept], bool)
        #: skip links join each mention to the next one of its key, and one in no entity to an entity's mention of the key,
        #: so a key costs two links per mention and a label reaches every mention in one step
        links = {(number[a], number[b]) for g in groups for a, b in [*zip(g, g[1:], strict=False), *self._anchors(g, tokens)]}
        self.skip = np.array(sorted(links), int).reshape(-1, 2)
        self.chain = np.array([(k, k + 1) for k in range(len(kept) - 1) if self.tokens[k][3] + 1 == self.tokens[k + 1][3]], int).reshape(-1, 2)

        #: tokens with a digit or "@", or long enough for a key, that nothing links to an entity: known to be none, for fitting
        self.others = [
            (shape(text[t[0] : t[1]]), tokens[n - 1][2] if n and tokens[n - 1][3] + 1 == t[3] else 0)
            for n, t in enumerate(tokens)
            if not t[2] and n not in number and (t[1] - t[0] >= KEY_CHARS or "@" in text[t[0] : t[1]] or _DIGIT.search(text, t[0], t[1]))
        ]

    @staticmethod
    def _anchors(group: list[int], tokens: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, int]]:
        """Links of the mentions in no entity: to the last mention before that is in one, or else to the first one."""
        last = next(n for n in group if tokens[n][2])
        for n in group:
            if tokens[n][2]:
                last = n
            else:
                yield min(n, last), max(n, last)

    def patterns(self) -> Iterator[tuple[int, int, int, int]]:
        """(shape, label before, known label of a linked token or -1, label) of each token whose label is known.

        Known are the tokens of base spans, and as none those of `others`. What is linked to an entity and stands in no
        base span is what the field has to decide; it is not fitted on.
        """
        before, linked = np.zeros(len(self.tokens), int), np.full(len(self.tokens), -1)
        before[self.chain[:, 1]] = self.labels[self.chain[:, 0]]
        for a, b in self.skip:
            linked[a], linked[b] = max(linked[a], self.labels[b] or -1), max(linked[b], self.labels[a] or -1)
        yield from ((a, b, -1, 0) for a, b in self.others)
        for n in np.flatnonzero(self.labels).tolist():
            yield int(self.shapes[n]), int(before[n]), int(linked[n]), int(self.labels[n])

    def beliefs(self, weights: Weights, rounds: int | None = None) -> np.ndarray:
        """Label probabilities of the tokens by loopy message passing; base tokens are fixed.

        Messages go until none changes, by default for as many rounds at most as damped ones need to cross the graph.
        """
        rounds = 100 + 4 * len(self.tokens) if rounds is None else rounds
        unary = weights.shape[self.shapes].copy()
        unary[self.things, 1:] -= NAMED_THING
        fixed = self.labels > 0
        unary[fixed] = -np.inf  # no number of messages from repeats outweighs it
        unary[fixed, self.labels[fixed]] = 0.0
        edges = np.vstack([self.chain, self.skip])
        pair = np.concatenate([np.repeat(weights.chain[None], len(self.chain), 0), np.repeat(weights.skip * np.eye(LABELS)[None], len(self.skip), 0)])
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        pair = np.concatenate([pair, pair.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        sent = np.zeros((len(source), LABELS))
        for _ in range(rounds):
            total = unary.copy()
            np.add.at(total, target, sent)
            out = total[source] - sent[back]
            new = np.logaddexp.reduce(out[:, :, None] + pair, axis=1)
            new = 0.5 * sent + 0.5 * (new - new.max(1, keepdims=True))
            if np.abs(new - sent).max(initial=0) < 1e-6:
                break
            sent = new
        total = unary.copy()
        np.add.at(total, target, sent)
        total = np.exp(total - total.max(1, keepdims=True))
        return total / total.sum(1, keepdims=True)

    def added(self, weights: Weights) -> list[Span]:
        """Spans of the tokens that the field marks besides the base ones; neighbours of one label make one span."""
        if not len(self.skip) or self.labels.all():
            return []
        p = self.beliefs(weights)
        out: list[list[int]] = []
        last = None
        for n in np.flatnonzero((self.labels == 0) & (p[:, 1:].max(1) >= BELIEF)).tolist():
            a, b, _, i = self.tokens[n]
            kind = int(p[n, 1:].argmax())
            if last == (kind, i - 1):
                out[-1][2] = b
            else:
                out.append([kind, a, b])
            last = kind, i
        return [tuple(s) for s in out]


class Weights:
    """Log potentials: of a shape with a label, of a label after a label, and for linked tokens to agree."""

    def __init__(self, counts: dict[tuple[int, int, int, int], int], rounds: int = 300):
        """Fitted by pseudo-likelihood on pattern counts, with a prior that linked tokens and neighbours agree."""
        self.shape, self.chain, self.skip = np.zeros((SHAPES, LABELS)), 0.5 * np.eye(LABELS), 4.0
        if not counts:
            return
        rows = np.array([k for k in sorted(counts)])
        n = np.array([float(counts[k]) for k in sorted(counts)])
        n = np.log1p(n)  # a common pattern counts for more, but not by its share of the corpus
        n /= n.sum()
        s, before, linked, y = rows.T
        hot = np.eye(LABELS)
        has = (linked >= 0).astype(float)[:, None]
        prior_chain, prior_skip = self.chain.copy(), self.skip
        for k in range(rounds):
            z = self.shape[s] + self.chain[before] + self.skip * hot[np.maximum(linked, 0)] * has
            p = np.exp(z - z.max(1, keepdims=True))
            g = (p / p.sum(1, keepdims=True) - hot[y]) * n[:, None]
            step = 4.0 / (1 + 0.01 * k)
            grad_shape = np.zeros_like(self.shape)
            np.add.at(grad_shape, s, g)
            grad_chain = np.zeros_like(self.chain)
            np.add.at(grad_chain, before, g)
            grad_skip = float((g * hot[np.maximum(linked, 0)] * has).sum())
            self.shape -= step * (grad_shape + 0.01 * self.shape)
            self.chain -= step * (grad_chain + 0.01 * (self.chain - prior_chain))
            self.skip -= step * (grad_skip + 0.01 * (self.skip - prior_skip))


def fit(docs: DataFrame) -> Weights:
    """Weights from the patterns of all documents with base spans; the driver gets the count of each distinct pattern.

    There are at most SHAPES * LABELS * (LABELS + 1) * LABELS patterns, whatever the size of the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for t in batch.column("_text"):
                text = t.as_py()
                if base := base_spans(text):
                    counts.update(Field(text, base).patterns())
        rows = [(*k, n) for k, n in counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], names=["s", "b", "l", "y", "n"])

    found = docs.select(text_or_empty("text").alias("_text")).mapInArrow(run, "s long, b long, l long, y long, n long")
    return Weights({(r.s, r.b, r.l, r.y): r.n for r in found.groupBy("s", "b", "l", "y").agg(F.sum("n").alias("n")).collect()})


def _render(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, keep: list[str], weights: Weights, redact: bool = False) -> DataFrame:
    """keep, n_email, n_ip, n_card, n_phone, base (base spans as text), spans (all); with redact also clean.

    The counts are of the base spans. clean is the text with each span replaced by its kind in brackets; of spans that
    overlap, the longer text between them goes under the first one's kind.
    """
    source = docs.select(*keep, text_or_empty("text").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    more = [*(f"n_{k}" for k in KINDS), "base", "spans", *(["clean"] if redact else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            rows = []
            for t in batch.column("_text"):
                text = t.as_py()
                base = base_spans(text)
                every = sorted(base + Field(text, base).added(shared.value)) if base else base
                tally = [sum(s[0] == k for s in base) for k in range(len(KINDS))]
                rows.append((*tally, _render(base), _render(every), *([_redact(text, every)] if redact else [])))
            columns = [pa.array(c, pa.int64() if k < len(KINDS) else pa.string()) for k, c in enumerate(zip(*rows, strict=True))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], names=[*keep, *more])

    like = source.drop("_text").withColumns({c: F.lit(0).cast("long") if c[:2] == "n_" else F.lit("") for c in more})
    return source.mapInArrow(run, like.schema)


def _redact(text: str, spans: list[Span]) -> str:
    out, end = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"[{KINDS[k].upper()}]"]
        end = max(end, b)
    return "".join(out) + text[end:]


def personal_data(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and the columns of find(). Null and empty texts have no spans; one row per row of docs."""
    return find(docs, list(keep), fit(docs))


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced; null texts stay null. n_chars, if there, follows the new text."""
    whole = docs.select("text", F.struct(*docs.columns).alias("_doc"))
    found = find(whole, ["_doc"], fit(docs), redact=True)
    text = F.when(F.col("_doc.text").isNull(), None).otherwise(F.col("clean"))
    chars = F.when(F.col("spans") == "", F.col("_doc")["n_chars"]).otherwise(F.length("clean")) if "n_chars" in docs.columns else None
    return found.select(
        *(text.alias(c) if c == "text" else chars.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("_doc")[c].alias(c) for c in docs.columns)
    )
