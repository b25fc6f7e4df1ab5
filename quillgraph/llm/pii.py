"""Personal data: base patterns, and a skip-chain conditional random field.

The base finds emails, IPv4 addresses, payment cards and phone numbers by pattern and
validation. The CRF labels the document's candidate tokens (those with a digit or @;
all other tokens are O for sure and cut the chain) with O or a kind:

* node potentials: a linear model of a token's shape;
* chain potentials between adjacent candidate tokens;
* skip potentials between distant tokens that are the same, or the same but for
  punctuation and case, so that one occurrence that is certain makes the others likely.

All weights are fitted by pseudo-likelihood on a bounded sample of documents that the
base labels. To these, mentions are added that the base can't read: base spans with
their marks changed (1[.]2[.]3[.]4, a number without its +), which keep their label, and
other tokens changed alike and everyday numbers, which are O; so the shape alone doesn't tell, and how far
to trust a repeat is learned. Matches that failed as phone numbers, and might hold one,
say nothing. In a kept part of the sample a share of the base spans is hidden as well;
the threshold is the least one at which what is found there among hidden and changed
spans is right in PRECISION of the cases.

When spans are looked for, base spans are evidence (clamped). Loopy sum-product message
passing runs over all documents of an Arrow batch at once. Repeats are linked
first-to-each and each-to-next, so edges are linear in tokens. Spans whose tokens reach
the threshold are added; base spans stay.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import small_batches, table, written

KINDS = ("email", "ip", "card", "phone")
#: Documents that fit the CRF at most, about how many are looked at for them, and how
#: many characters of candidate tokens (and what stands between) they have in all.
TRAIN_DOCS = 1000
TRAIN_AMONG = 5000
TRAIN_CHARS = 4_000_000
#: Of found tokens in the kept part of the sample, so many must be right.
PRECISION = 0.99
#: The threshold where the sample can't tell.
THRESHOLD = 0.9
HIDDEN = 1 / 3
#: Neighbouring tokens of a kind become one span up to so many digits.
MOST_DIGITS = (0, 0, 19, 15)
#: Prior mean of the skip potentials' agreement weight.
AGREEMENT = 1.0
ROUNDS = 30
SEED = 9

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match can only start where a run of digits does: inside, the same tail fails again.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_TRIM = ".,;:!?\"'()[]{}<>"

Span = tuple[int, int, int]  # kind's place in KINDS, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _octet(digits: str) -> bool:
    """At most 255, however many digits or leading zeros there are."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """By @ signs: the local part is the run of its characters that ends there."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1  # nothing before this @ can be in a later local part
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """The base's spans by kind and start, and the matches that failed validation."""
    found: list[Span] = []
    failed: list[Span] = []
    if not _HINT.search(text):
        return found, failed
    found += ((0, a, b) for a, b in _emails(text))
    for m in _IP.finditer(text):
        if all(map(_octet, m[0].split("."))):
            found.append((1, *m.span()))
        else:
            failed.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19:
            if luhn(digits):
                found.append((2, *m.span()))
            else:
                failed.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            found.append((3, *m.span()))
        else:
            failed.append((3, *m.span()))
    return found, failed


def candidate_tokens(text: str) -> list[tuple[int, int]]:
    """White-space separated tokens with a digit or @."""
    out, at = [], 0
    while m := _HINT.search(text, at):
        start = end = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        n = len(text)
        while end < n and not text[end].isspace():
            end += 1
        out.append((start, end))
        at = end
    return out


#: The node features, in order; each is 0 or 1. The last is set by the graph.
FEATURES = (
    "bias", "@", "@ and dot after", "plus", "paren", "quote", "equals", "letter", "only digits", "3 dots", "1 or 2 dots", "dash",
    "digits 1", "digits 2-3", "digits 4", "digits 5-8", "digits 9-12", "digits 13-19", "digits 20+", "ends in punctuation", "long",
    "bracket", "slash", "fails Luhn", "part over 255", "in a refuted card or address",
)


def features(token: str) -> list[int]:
    digits = _NOT_DIGIT.sub("", token)
    n = len(digits)
    body = token.rstrip(_TRIM)
    letter = any(c.isalpha() for c in token)
    dots = body.count(".")
    parts = [x for x in _NOT_DIGIT.split(body) if x] if dots == 3 else []
    return [
        1, "@" in token, "@" in token and "." in body.partition("@")[2], token[0] == "+", "(" in token, '"' in token, "=" in token, letter, body.isdigit(), dots == 3, 0 < dots < 3, "-" in body,
        n == 1, 2 <= n <= 3, n == 4, 5 <= n <= 8, 9 <= n <= 12, 13 <= n <= 19, n >= 20, body != token, len(token) > 40,
        "[" in token, "/" in token, 13 <= n <= 19 and not luhn(digits), len(parts) == 4 and not all(map(_octet, parts)), 0,
    ]


def _same(token: str) -> str:
    """Tokens that agree in this are the same or similar: case and punctuation go."""
    return "".join(c for c in token.lower() if c.isalnum() or c == "@")


class Graph:
    """The candidate tokens of some documents with their chain and skip edges.

    `labels` are the base's (the evidence), `truth` those and, for texts with known
    further spans, theirs; tokens in failed phone matches are `unsure`. With a generator,
    a share of the base's spans is no evidence but `hidden`."""

    def __init__(self, texts: list[str], known: list[list[Span]] | None = None, rng: np.random.Generator | None = None):
        self.spans, self.base, docs, starts, feats = [], [], [], [], []
        chain, skip, labels, truth, unsure, hidden = [], [], [], [], [], []
        for k, text in enumerate(texts):
            base, failed = base_spans(text)
            self.base.append(base)
            first: dict[str, int] = {}
            last: dict[str, int] = {}
            previous = -1
            hide = rng.random(len(base)) < HIDDEN if rng is not None else np.zeros(len(base), bool)
            marks = [(a, b, "base", kind + 1, h) for (kind, a, b), h in zip(base, hide)] + [(a, b, "failed", kind + 1, False) for kind, a, b in failed]
            marks += [(a, b, "known", kind + 1, False) for kind, a, b in (known[k] if known else ())]
            marks.sort()
            seen, open_marks = 0, []
            for a, b in candidate_tokens(text) if _HINT.search(text) else ():
                i = len(docs)
                docs.append(k)
                starts.append((a, b))
                token = text[a:b]
                own = features(token)
                while seen < len(marks) and marks[seen][0] < b:
                    open_marks.append(marks[seen])
                    seen += 1
                open_marks = [m for m in open_marks if m[1] > a]
                by = max(((m[3], m[4]) for m in open_marks if m[2] == "base"), default=(0, False))
                further = max((m[3] for m in open_marks if m[2] == "known"), default=0)
                wrong = {m[3] for m in open_marks if m[2] == "failed"}
                own[-1] = int(not by[0] and bool(wrong & {2, 3}))
                feats.append(own)
                hidden.append(by[1])
                labels.append(0 if by[1] else by[0])
                truth.append(by[0] or further)
                unsure.append(not by[0] and not further and 4 in wrong)
                if previous >= 0 and text[starts[previous][1] : a].isspace() and a - starts[previous][1] <= 2:
                    chain.append((previous, i))
                previous = i
                key = _same(token)
                if len(key) >= 3:
                    if key in first:
                        skip.append((last[key], i))
                        if first[key] != last[key]:
                            skip.append((first[key], i))
                    else:
                        first[key] = i
                    last[key] = i
        n = len(docs)
        self.n, self.docs, self.tokens = n, np.array(docs, np.int64), starts
        self.features = np.array(feats, np.float64).reshape(n, len(FEATURES))
        self.labels, self.truth = np.array(labels, np.int64), np.array(truth, np.int64)
        self.unsure, self.hidden = np.array(unsure, bool), np.array(hidden, bool)
        self.chain = np.array(chain, np.int64).reshape(-1, 2)
        self.skip = np.array(skip, np.int64).reshape(-1, 2)


def changed(kind: int, span: str, rng: np.random.Generator) -> str | None:
    """A mention of the span as the base can't read it; kind 4 is any other token."""
    digits = _NOT_DIGIT.sub("", span)
    if kind == 3:
        rest = span.partition(" ")[2]
        return rest if len(_NOT_DIGIT.sub("", rest)) >= 5 else None
    if kind == 0 or kind == 4 and "@" in span:
        return span.replace("@", "[@]")
    if kind == 2 or kind == 4 and len(digits) >= 8 and "." not in span:
        return "/".join(span[i : i + 4] for i in range(0, len(span), 4)) if " " not in span else "/".join(span.split())
    if "." in span.strip("."):
        return span.strip(".").replace(".", str(rng.choice(["[.]", "/"])))
    return f"[{span}]"


def plain_number(rng: np.random.Generator) -> str:
    """A number of everyday sorts: a count, a year, a decimal, a date, a code."""
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    sort = rng.integers(4)
    if sort == 0:
        return digits(rng.integers(1, 13)) + str(rng.choice(["", ".", ","]))
    if sort == 1:
        return ".".join(digits(rng.integers(1, 4)) for _ in range(rng.integers(2, 4)))
    if sort == 2:
        return str(rng.choice(["-", "/"])).join([digits(4), digits(2), digits(2)])
    return f"{chr(97 + rng.integers(26))}{digits(rng.integers(1, 9))}"


def with_mentions(text: str, rng: np.random.Generator) -> tuple[str, list[Span]]:
    """The text, and behind it some of its spans and other tokens in changed form, and
    a plain number, between words; and where those spans are."""
    base, failed = base_spans(text)
    taken = [(a, b) for _, a, b in base] + [(a, b) for k, a, b in failed if k == 3]
    other = [(4, a, b) for a, b in candidate_tokens(text) if len(_same(text[a:b])) >= 3 and not any(s < b and a < e for s, e in taken)]
    known: list[Span] = []
    for kind, a, b in [*base, *other]:
        if rng.random() < 0.5 and (form := changed(kind, text[a:b], rng)):
            text += " x "
            if kind < 4:
                known.append((kind, len(text), len(text) + len(form)))
            text += form + " x"
    if rng.random() < 0.5:
        text += f" x {plain_number(rng)} x"
    return text, known


def _pseudo(g: Graph, steps: int, rate: float, l2: float) -> dict[str, np.ndarray]:
    c = len(KINDS) + 1
    node, chain, skip = np.zeros((len(FEATURES), c)), np.zeros((c, c)), np.eye(c) * AGREEMENT
    prior = skip.copy()
    if g.n == 0:
        return {"node": node, "chain": chain, "skip": skip}
    y, sure = np.eye(c)[g.truth], (~g.unsure)[:, None]
    before, after, linked = np.zeros((g.n, c)), np.zeros((g.n, c)), np.zeros((g.n, c))
    np.add.at(before, g.chain[:, 1], y[g.chain[:, 0]] * sure[g.chain[:, 0]])
    np.add.at(after, g.chain[:, 0], y[g.chain[:, 1]] * sure[g.chain[:, 1]])
    for a, b in ((0, 1), (1, 0)):
        np.add.at(linked, g.skip[:, a], y[g.skip[:, b]] * sure[g.skip[:, b]])
    weights = [node, chain, skip]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    for t in range(1, steps + 1):
        z = g.features @ node + before @ chain + after @ chain.T + linked @ skip
        p = np.exp(z - z.max(1, keepdims=True))
        d = (y - p / p.sum(1, keepdims=True)) * sure
        agree = linked.T @ d / g.n - l2 * (skip - prior)
        steepest = [g.features.T @ d / g.n - l2 * node, (before.T @ d + d.T @ after) / g.n - l2 * chain, (agree + agree.T) / 2]
        for w, (m, v), grad in zip(weights, moments, steepest):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            w += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return {"node": node, "chain": chain, "skip": skip}


def least_threshold(sure: np.ndarray, right: np.ndarray, precision: float = PRECISION) -> float:
    """The least marginal, one half at least, from which on found tokens are right so
    often; above all of them where none is."""
    order = np.argsort(-sure, kind="stable")
    share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero((share >= precision) & (sure[order] >= 0.5))
    if not len(good):
        return float(sure.max(initial=0.5)) + 1e-9 if len(sure) else THRESHOLD
    last = good[-1]
    after = sure[order][last + 1] if last + 1 < len(order) else 0.5
    return float(max(0.5, (sure[order][last] + after) / 2))


def fit(texts: list[str], *, steps: int = 400, rate: float = 0.05, l2: float = 1e-4, precision: float = PRECISION) -> dict:
    """node, chain, skip weights (pseudo-likelihood by gradient ascent with Adam's step
    sizes) and the threshold. Every fourth text is kept for the threshold.

    Without a candidate token, or with labels of one sort, the priors remain."""
    rng = np.random.default_rng(SEED)
    more = [with_mentions(t, rng) for t in texts]
    part = lambda keep: [m for i, m in enumerate(more) if (i % 4 == 3) == keep]
    learn, kept = part(False), part(True)
    model = _pseudo(Graph([t for t, _ in learn], [k for _, k in learn]), steps, rate, l2)
    g = Graph([t for t, _ in kept], [k for _, k in kept], rng)
    found = []
    if g.n:
        p = marginals(g, model)[:, 1:]
        kind, sure = p.argmax(1) + 1, p.max(1)
        asked = (g.labels == 0) & ~g.unsure
        for own in (asked & g.hidden, asked & ~g.hidden & (g.truth > 0)):  # hidden spans; changed ones; each with all that isn't a span
            if own.any():
                own = own | asked & (g.truth == 0)
                found.append(least_threshold(sure[own], (kind == g.truth)[own], precision))
    return model | {"threshold": max(found, default=THRESHOLD)}


def marginals(g: Graph, model: dict, *, rounds: int = ROUNDS) -> np.ndarray:
    """Loopy sum-product over all tokens; base tokens are clamped to their label."""
    score = g.features @ model["node"]
    clamped = g.labels > 0
    score[clamped] = -50.0
    score[clamped, g.labels[clamped]] = 0.0
    return propagated(score, g.chain, g.skip, model["chain"], model["skip"], rounds=rounds)


def propagated(score: np.ndarray, chain: np.ndarray, skip: np.ndarray, chain_weight: np.ndarray, skip_weight: np.ndarray, *, rounds: int = ROUNDS) -> np.ndarray:
    """Marginals of a pairwise field with the log-potentials `score` of nodes and two
    kinds of edges: exact without loops (and enough rounds), else approximate."""
    c = score.shape[1]
    if not len(chain) + len(skip):
        p = np.exp(score - score.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)
    edges = np.vstack([chain, skip])
    source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    e = len(edges)
    forward = np.concatenate([np.repeat(chain_weight[None], len(chain), 0), np.repeat(skip_weight[None], len(skip), 0)])
    pots = np.exp(np.concatenate([forward, forward.transpose(0, 2, 1)]))
    back = np.concatenate([np.arange(e, 2 * e), np.arange(e)])
    msg = np.zeros((2 * e, c))
    for _ in range(rounds):
        belief = score.copy()
        np.add.at(belief, target, msg)
        out = belief[source] - msg[back]
        out = np.exp(out - out.max(1, keepdims=True))
        new = np.log(np.einsum("ei,eij->ej", out, pots) + 1e-300)
        new -= new.max(1, keepdims=True)
        new = 0.3 * msg + 0.7 * new
        change, msg = np.abs(new - msg).max(), new
        if change < 1e-5:
            break
    belief = score.copy()
    np.add.at(belief, target, msg)
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def all_spans(texts: list[str], model: dict, *, threshold: float | None = None) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text, by kind and start."""
    threshold = model["threshold"] if threshold is None else threshold
    g = Graph(texts)
    out = [(base, list(base)) for base in g.base]
    if g.n:
        p = marginals(g, model)
        kind = p[:, 1:].argmax(1)
        sure = (p[np.arange(g.n), kind + 1] >= threshold) & (g.labels == 0)
        runs: dict[int, list[Span]] = {}
        for i in np.flatnonzero(sure):
            d, (a, b) = int(g.docs[i]), g.tokens[i]
            text, k = texts[d], int(kind[i])
            while a < b and text[a] in _TRIM and not (k == 3 and text[a] == "("):
                a += 1
            while b > a and text[b - 1] in _TRIM and not (k == 3 and text[b - 1] == ")"):
                b -= 1
            if a == b or any(s < b and a < e for _, s, e in out[d][0]):
                continue
            own = runs.setdefault(d, [])
            if own and own[-1][0] == k and text[own[-1][2] : a].isspace() and a - own[-1][2] <= 2 and len(_NOT_DIGIT.sub("", text[own[-1][1] : b])) <= MOST_DIGITS[k]:
                own[-1] = (k, own[-1][1], b)
            else:
                own.append((k, a, b))
        for d, own in runs.items():
            out[d][1].extend(own)
            out[d][1].sort()
    return out


def spans_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span as <KIND>; where spans overlap, the earliest, then
    the longest wins, and what sticks out of the others goes as well."""
    out, at = [], 0
    for a, b, k in sorted((a, -b, k) for k, a, b in spans):
        b = -b
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def reduced(text: str) -> str:
    """The candidate tokens and what stands between neighbours, other words as an x:
    all that the graph sees of a text."""
    out, at = [], 0
    for a, b in candidate_tokens(text):
        gap = text[at:a]
        out += [gap if len(gap) <= 40 and not any(c.isalpha() for c in gap) else " x ", text[a:b]]
        at = b
    return "".join(out) + (" x" if out else "")


def training_sample(docs: DataFrame, *, limit: int = TRAIN_DOCS, among: int = TRAIN_AMONG, chars: int = TRAIN_CHARS) -> list[str]:
    """At most `limit` different reduced texts with a digit or @, of about `among`
    documents that a seeded hash of id and text picks (all documents, where there are
    fewer), in all of at most `chars` characters.

    Repeated rows count once, so a hot row neither fills the sample nor the driver."""
    parts, n = 1_000_000, docs.count()
    share = parts if n <= among else max(1, int(parts * among / n))
    h = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text", F.lit(SEED))

    def reduce(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            small = [reduced(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in small], pa.int64()), pa.array(small, pa.string())], names=["h", "n", "small"])

    few = docs.where(F.col("text").rlike("[0-9@]")).select(h.alias("h"), "text").where(F.pmod("h", F.lit(parts)) < share)
    rows = written(few.mapInArrow(reduce, "h long, n long, small string").groupBy("h").agg(F.first("n").alias("n"), F.first("small").alias("small")), "pii-sample")
    chosen, total = [], 0
    for r in rows.orderBy("h").select("h", "n").limit(limit).collect():
        if total + r.n <= chars:
            chosen.append(r.h)
            total += r.n
    if not chosen:
        return []
    return [r.small for r in sorted(rows.where(F.col("h") <= chosen[-1]).where(F.col("h").isin(chosen) if len(chosen) < limit else F.lit(True)).select("h", "small").collect())]


def train(docs: DataFrame) -> dict:
    return fit(training_sample(docs))


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_spans(docs: DataFrame, model: dict, *, threshold: float | None = None) -> DataFrame:
    """A row per document: counts of base spans by kind, their digest, and all spans.

    Null and empty texts have none; repeated rows are kept; other columns are ignored."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = all_spans(texts, model, threshold=threshold)
            counts = [[sum(s[0] == k for s in base) for base, _ in found] for k in range(len(KINDS))]
            digests = [hashlib.sha256(spans_text(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array([spans_text(s) for _, s in found], pa.string())],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def redact_documents(docs: DataFrame, model: dict, *, threshold: float | None = None) -> DataFrame:
    """The documents with personal data replaced; n_chars follows the new text."""
    names = docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(names.index("text")).to_pylist()
            found = all_spans([t or "" for t in texts], model, threshold=threshold)
            clean = [t if t is None or not s else redact(t, s) for t, (_, s) in zip(texts, found)]
            columns = [pa.array(clean, pa.string()) if c == "text" else batch.column(i) for i, c in enumerate(names)]
            if "n_chars" in names:
                i = names.index("n_chars")
                old = batch.column(i).to_pylist()
                columns[i] = pa.array([o if t == c else len(c) for o, t, c in zip(old, texts, clean)], columns[i].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of documents: a row for each row; null and empty
    texts have no spans, repeated rows are kept, null ids stay null."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return find_spans(docs, train(docs))
