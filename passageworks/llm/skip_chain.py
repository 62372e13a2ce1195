"""Personal data: base patterns, and a skip-chain conditional random field over number-like tokens."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passageworks.llm.common import clean, slices

KINDS = ("email", "ip", "card", "phone")
OTHER, LABELS = 0, 1 + len(KINDS)
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARKED = re.compile(r"[0-9@]")
TOKEN = re.compile(r"\S+")
PUNCTUATION = ".,;:!?()[]{}<>'\"|"
#: Hashed features of a token, and the least marginal that adds a span.
SIZE, SURE = 1 << 12, 0.9
#: Messages are passed until none changes by more than SETTLED; damping makes that a few dozen rounds. ROUNDS ends a graph that swings for ever.
SETTLED, ROUNDS = 1e-5, 2000
#: Strings of the same form that are put into a teaching text with each repeat; two of them stand there twice.
STRANGERS = 3
#: Weight that holds a token inside a base span to its label.
HELD = 30.0
#: The fitting sample: about so many documents, each of at most so many code points.
SAMPLE_DOCS, FIT_CHARS, FIT_TOKENS = 10_000, 20_000, 60_000

Span = tuple[int, int, int]  # start, number of the kind, end


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Leftmost non-overlapping matches, found from each @ outwards so that no run is read twice."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, 0, found.end()
            free = found.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(free, at + 1))


def base_spans(text: str) -> list[Span]:
    """Base spans by start, then kind."""
    out: list[Span] = []
    if "@" in text:
        out += emails(text)
    for m in IP.finditer(text):
        if all(len(p) <= 3 or not p[:-3].strip("0") for p in m[0].split(".")) and all(int(p[-3:]) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


@dataclass
class Graph:
    """The tokens of one document that hold a digit or @, chain edges between them, and classes of like tokens.

    Every class is a hub that each of its tokens has an edge (token, hub) to, so any two of them are two steps apart.
    """

    starts: list[int]
    ends: list[int]
    features: list[list[int]]
    chain: np.ndarray
    spokes: np.ndarray
    hubs: int

    @property
    def size(self) -> int:
        return len(self.starts)


def shape(token: str) -> str:
    return re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"[0-9]", "9", token)))


def likenesses(token: str, digits: str) -> set[str]:
    """What equal or similar tokens share: letters and digits; all digits, and the last seven; what stands before an @."""
    bare = re.sub(r"\W", "", token.lower())
    found = {f"w{bare}", f"l{token.partition('@')[0].strip(PUNCTUATION).lower()}"} if bare else set()
    if len(digits) >= 7:
        found |= {f"d{digits}", f"e{digits[-7:]}"}
    return found


def graph(text: str) -> Graph:
    """Chain edges join neighbours in the text; hubs join all tokens of equal or similar form, however far apart. Tokens are read whole."""
    starts, ends, feats, chain = [], [], [], []
    classes: dict[int, list[int]] = {}
    before, past = "", -1
    for m in TOKEN.finditer(text):
        token = m[0]
        if not MARKED.search(token):
            before = token
            continue
        k = len(starts)
        digits = "".join(c for c in token if "0" <= c <= "9")
        names = [f"s{shape(token)}", f"d{min(len(digits), 20)}", f"n{min(len(token), 24)}", f"p{token[0] if not token[0].isalnum() else 'w'}", f"b{shape(before)}"]
        names += [f"h{c}" for c in "@.-()+:/=" if c in token] + [f"t{min(token.count('.'), 9)}"]
        names += ["valid"] if 12 <= len(digits) <= 19 and luhn(digits) else []
        starts.append(m.start())
        ends.append(m.end())
        feats.append(sorted({zlib.crc32(n.encode()) % SIZE for n in names}))
        if k and past == k - 1 and before == "":
            chain.append((k - 1, k))
        for key in likenesses(token, digits):
            classes.setdefault(xxhash.xxh64_intdigest(key), []).append(k)
        before, past = "", k
    kept = sorted({tuple(c) for c in classes.values() if len(c) > 1})
    spokes = [(k, hub) for hub, members in enumerate(kept) for k in members]
    return Graph(starts, ends, feats, np.array(chain, np.int64).reshape(-1, 2), np.array(spokes, np.int64).reshape(-1, 2), len(kept))


def labels_of(g: Graph, spans: list[Span]) -> np.ndarray:
    """Each token's label: the first span that overlaps it."""
    out, k = np.zeros(g.size, np.int64), 0
    for i in range(g.size):
        while k < len(spans) and spans[k][2] <= g.starts[i]:
            k += 1
        if k < len(spans) and spans[k][0] < g.ends[i]:
            out[i] = spans[k][1] + 1
    return out


def common(labels: np.ndarray) -> int:
    """The most frequent kind among labels, 0 if none has one; of equal ones the first."""
    kinds = np.bincount(labels, minlength=LABELS)[1:]
    return int(kinds.argmax()) + 1 if kinds.any() else OTHER


def hub_labels(g: Graph, known: np.ndarray) -> list[int]:
    kinds = np.zeros((g.hubs, LABELS), np.int64)
    np.add.at(kinds, (g.spokes[:, 1], known[g.spokes[:, 0]]), 1)
    kinds = kinds[:, 1:]
    return np.where(kinds.any(axis=1), kinds.argmax(axis=1) + 1, OTHER).tolist()


def repeat_of(span: str, kind: int, rng: np.random.Generator) -> str | None:
    """A clear mention as it is repeated in passing: the name before the @, digits with other marks or none, a phone number's last part."""
    digits = re.sub(r"[^0-9]", "", span)
    if KINDS[kind] == "email":
        name = span.partition("@")[0]
        return name if MARKED.search(name) else None
    if KINDS[kind] == "phone":
        return [digits, f"{digits[-7:-4]}-{digits[-4:]}"][rng.integers(2)] if len(digits) >= 9 else None
    mark = "-" if KINDS[kind] == "ip" else ":"
    size = 3 if KINDS[kind] == "ip" else 4
    return mark.join(digits[k : k + size] for k in range(0, len(digits), size))


def other_than(word: str, rng: np.random.Generator) -> str:
    """A string of the same form with letters and digits of its own."""
    return "".join(str(rng.integers(10)) if c.isdigit() else chr(97 + rng.integers(26)) if c.isalpha() else c for c in word)


def taught(text: str, rng: np.random.Generator) -> tuple[str, list[Span]]:
    """The text with repeats and strangers put between its words, and the repeats' spans."""
    base = base_spans(text)
    put: list[tuple[int, str, int]] = []
    gaps = [m.start() for m in re.finditer(" ", text) if not any(s < m.start() < e for s, _, e in base)]
    for start, kind, end in base:
        word = repeat_of(text[start:end], kind, rng) if gaps else None
        if word and not base_spans(word):
            strangers = [other_than(word, rng) for _ in range(STRANGERS)]
            put += [(gaps[rng.integers(len(gaps))], word, kind), *((gaps[rng.integers(len(gaps))], w, -1) for w in strangers + strangers[:2])]
    out, at, spans, size = [], 0, [], 0
    for gap, word, kind in sorted(put):
        out += [text[at:gap], " ", word]
        size += gap - at + 1 + len(word)
        if kind >= 0:
            spans.append((size - len(word), kind, size))
        at = gap
    return "".join(out) + text[at:], spans


@dataclass
class SkipChain:
    """Weights of token features, of neighbouring labels, and of the label of a hub and that of its token."""

    token: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, g: Graph, known: np.ndarray) -> np.ndarray:
        """Label probabilities of the tokens by loopy sum-product over chain and hub edges.

        Tokens with a ``known`` label are held to it, and so are hubs of classes with such a token.
        """
        local = np.zeros((g.size + g.hubs, LABELS))
        local[: g.size] = np.stack([self.token[:, f].sum(axis=1) for f in g.features])
        held = np.flatnonzero(known)
        local[held] = 0
        local[held, known[held]] = HELD
        for hub, label in enumerate(hub_labels(g, known)):
            local[g.size + hub, label] = HELD * (label > 0)
        edges = np.concatenate([g.chain, np.stack([g.spokes[:, 1] + g.size, g.spokes[:, 0]], axis=1)])
        if len(edges):
            ahead = np.concatenate([np.repeat(self.chain[None], len(g.chain), 0), np.repeat(self.skip[None], len(g.spokes), 0)])
            source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
            pair = np.concatenate([ahead, ahead.transpose(0, 2, 1)])
            back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
            message = np.zeros((2 * len(edges), LABELS))
            for _ in range(ROUNDS):
                belief = local.copy()
                np.add.at(belief, target, message)
                out = (belief[source] - message[back])[:, :, None] + pair
                top = out.max(axis=1, keepdims=True)
                new = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
                new = 0.5 * message + 0.5 * (new - new.max(axis=1, keepdims=True))
                change, message = abs(new - message).max(), new
                if change < SETTLED:
                    break
            np.add.at(local, target, message)
        local = local[: g.size]
        p = np.exp(local - local.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    @classmethod
    def fit(cls, texts: list[str], epochs: int = 6, rate: float = 0.3, seed: int = 3) -> SkipChain:
        """Pseudo-likelihood steps on tokens outside base spans, whose labels are distant ones.

        Base spans are the clear mentions. Each text is taught with bare repeats of some of its mentions, written in a way
        that no base pattern finds (they have the mention's label), and STRANGERS strings of the same form with characters of their own
        for each (they have none), put at random places. So form alone decides nothing and the links learn to carry the label.
        """
        rng = np.random.default_rng(seed)
        model = cls(np.zeros((LABELS, SIZE)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS)))
        held = [np.full_like(x, 1e-2) for x in (model.token, model.chain, model.skip)]
        cases, seen = [], 0
        for text in texts:
            if seen >= FIT_TOKENS:
                break
            text, repeats = taught(text, rng)
            g = graph(text)
            if g.size:
                base = base_spans(text)
                known, y = labels_of(g, base), labels_of(g, repeats)
                y[known > 0] = known[known > 0]
                cases.append((g, y, np.flatnonzero(known == 0)))
                seen += g.size
        for _ in range(epochs):
            for at in rng.permutation(len(cases)):
                g, y, free = cases[at]
                members = [g.spokes[g.spokes[:, 1] == hub, 0] for hub in range(g.hubs)]
                for i in rng.permutation(free):
                    feats = g.features[i]
                    left, right = g.chain[g.chain[:, 1] == i, 0], g.chain[g.chain[:, 0] == i, 1]
                    near = [common(y[members[hub][members[hub] != i]]) for hub in g.spokes[g.spokes[:, 0] == i, 1]]
                    z = model.token[:, feats].sum(axis=1) + model.chain[y[left]].sum(axis=0) + model.chain[:, y[right]].sum(axis=1) + model.skip[near].sum(axis=0)
                    step = -np.exp(z - z.max())
                    step /= -step.sum()
                    step[y[i]] += 1
                    if abs(step).max() < 1e-3:
                        continue
                    for table, total, where in [(model.token, held[0], (slice(None), feats)), *((model.chain, held[1], (y[j], slice(None))) for j in left), *((model.chain, held[1], (slice(None), y[j])) for j in right), *((model.skip, held[2], (label, slice(None))) for label in near)]:
                        gradient = step[:, None] if table is model.token else step
                        total[where] += gradient**2
                        table[where] += rate * gradient / np.sqrt(total[where])
        return model

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Runs of neighbouring tokens with one sure label that touch no base span."""
        g = graph(text)
        if not g.size:
            return []
        known = labels_of(g, base)
        p = self.marginals(g, known)
        label = np.where((p.max(axis=1) >= SURE) & (known == 0), p.argmax(axis=1), OTHER)
        joined = {int(b) for _, b in g.chain}
        out: list[Span] = []
        for i in np.flatnonzero(label):
            start, end = g.starts[i], g.ends[i]
            while end - start > 1 and not text[end - 1].isalnum():
                end -= 1
            while end - start > 1 and text[start] in PUNCTUATION:
                start += 1
            if out and int(i) in joined and label[i - 1] == label[i]:
                out[-1] = (out[-1][0], out[-1][1], end)
            else:
                out.append((start, len(KINDS) + int(label[i]) - 1, end))
        return out


def named(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k] if k < len(KINDS) else 'crf_' + KINDS[k - len(KINDS)]}:{s}:{e}" for s, k, e in spans)


def fit_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, sample_docs: int = SAMPLE_DOCS, fit_chars: int = FIT_CHARS) -> SkipChain:
    """Fit on a bounded sample: about ``sample_docs`` rows picked by a hash of the id, those of them with a digit or @."""
    rate = min(1.0, sample_docs / max(1, docs.count()))
    picked = clean(docs, id_col, text_col).toDF("i", "t").filter(F.pmod(F.xxhash64(F.col("i").cast("string"), F.lit("pii")), F.lit(1_000_003)) < rate * 1_000_003)
    rows = picked.filter((F.length("t") <= fit_chars) & F.col("t").rlike("[0-9@]")).collect()
    return SkipChain.fit([r["t"] for r in sorted(rows, key=lambda r: (str(r["i"]), r["t"]))])


def scan(docs: DataFrame, model: SkipChain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, found) for every row, over whole texts.

    The counts and the digest are of base spans. The field adds spans (``crf_`` and the kind) over tokens
    that no base span touches and that its marginals are sure of: repeats of a clear mention anywhere in the document. Offsets are
    code points, end exclusive; spans are ordered by start, then kind. Null text counts as empty: no spans. Null ids and repeated rows:
    each is returned. Very long texts are read whole. Other columns, of whatever name, are not read. Empty table: no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value
        for part in slices(batches):
            counts: list[list[int]] = [[] for _ in KINDS]
            digest, text_spans, found = [], [], []
            for text in part.column(1).to_pylist():
                base: list[Span] = []
                every = base
                if text and MARKED.search(text):
                    base = base_spans(text)
                    every = sorted(base + field.added(text, base))
                for k in range(len(KINDS)):
                    counts[k].append(sum(s[1] == k for s in base))
                digest.append(hashlib.sha256(named(base).encode()).hexdigest())
                text_spans.append(named(every))
                found.append([{"kind": named([s]).split(":")[0], "start": s[0], "end": s[2]} for s in every])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array(text_spans, pa.string()), pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "found"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return clean(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, found array<struct<kind:string,start:bigint,end:bigint>>")
