"""Operator 7, personal data with a skip-chain conditional random field.

The four base patterns give spans that always stay.  Variables of the field are the candidate chunks of a document: base spans
and other runs of digits or at-signs.  Neighbouring chunks are tied by chain potentials; chunks with the same or a similar key
(digits, or lower-cased address) by skip potentials, a bare chunk to the nearest base span with its key, however far apart.

Node weights and both tie tables are learned together by the gradient of the conditional likelihood, its expectations coming from
loopy message passing: in a bounded sample some base spans are hidden and bare repeats of some are written into the text, and the
field has to tell them from the other chunks by shape, context and ties.  What a chunk's shape says is bounded (``EVIDENCE``), and
for half of the bare repeats it is turned against them, so that ties are learned that can outvote it.  In use, base chunks are held
fixed, and a chunk whose best kind has a marginal of ``sure`` or more is added as a span: a shape alone cannot reach that.
``recovery`` measures how many hidden mentions of other documents are found, and how many of those found are right.

Defined results: null text counts as empty (no spans); very long texts take time in proportion to their length; a span never
overlaps a base span of any kind when it is added; repeated rows give repeated results; with nothing to learn from only ties of
equal kinds count; an empty table gives an empty result; columns beside id and text are not read (``redacted`` keeps them).
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

KINDS = ("email", "ip", "card", "phone")
# The base patterns.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")  # from the begin of a run of digits only: what fails there fails inside
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
NUMERIC = re.compile(r"\+?[0-9](?:[\x20().-]{0,2}[0-9]){6,}")
AT = re.compile(r"(?<![^\s@<>()\[\],;:])[^\s@<>()\[\],;:]++@[^\s@<>()\[\],;]+")
HOST = re.compile(r"(?<![A-Za-z0-9-])[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
OTHER, LABELS, FEATURES = 4, 5, 96
EVIDENCE = 1.25  # bound of a chunk's own log potentials


def digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def luhn(d: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(d)):
        x = ord(c) - 48
        if k % 2:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start.  Addresses are found from their at-sign: a match can only begin at the left end
    of the run of local characters before it (or where the match before ended), so no position is tried in vain."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        left = at
        while left > done and text[left - 1] in LOCAL_CHARS:
            left -= 1
        m = DOMAIN.match(text, at + 1) if left < at else None
        if m:
            out.append((0, left, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := digits(m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(digits(m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def chunks(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(label, start, end) in text order: base spans (the first of those that overlap), and candidates, labelled OTHER."""
    found = sorted([(a, -b, k) for k, a, b in base])
    taken, kept = -1, []
    for a, b, k in found:
        if a >= taken:
            kept.append((k, a, -b))
            taken = -b
    out, covered = list(kept), [(a, b) for _, a, b in base]
    covered.sort()
    starts = [a for a, _ in covered]
    furthest, ends = -1, []
    for _, b in covered:
        furthest = max(furthest, b)
        ends.append(furthest)
    def free(a, b):
        i = bisect.bisect_left(starts, b)
        return i == 0 or ends[i - 1] <= a

    last = -1
    more = []
    for m in NUMERIC.finditer(text):
        if sum(map(str.isdigit, m[0])) <= 19:
            more.append((m.start(), m.end()))
        else:  # several numbers in a row: each is a mention of its own
            more += [(m.start() + w.start(), m.start() + w.end()) for w in re.finditer(r"\S+", m[0]) if sum(map(str.isdigit, w[0])) >= 7]
    if "@" in text:
        more += [(m.start(), m.end()) for m in AT.finditer(text)]
    for a, b in sorted(more):
        if a >= last and free(a, b):
            out.append((OTHER, a, b))
            last = b
    return sorted(out, key=lambda x: x[1])


def features(text: str, a: int, b: int) -> list[int]:
    s = text[a:b]
    d = digits(s)
    before = re.findall(r"[^\W\d_]+", text[max(0, a - 16) : a].lower())
    out = [0, 1 + min(len(d), 24), 26 + ("@" in s), 28 + s.startswith("+"), 30 + min(s.count("."), 4), 35 + min(s.count(" "), 4), 40 + min(s.count("-"), 4)]
    if 16 <= len(d) <= 19:
        out.append(45 + luhn(d))
    out.append(47 + bool(HOST.search(s)))
    out.append(50 + zlib.crc32((before[-1] if before else "").encode()) % (FEATURES - 50))
    return out


def keys(text: str, a: int, b: int) -> list[str]:
    """What makes chunks alike: the address, or the digits and the last nine of them."""
    s = text[a:b]
    if "@" in s:
        local = s.lower().strip(".")
        return ["@" + local, "@" + local.split(".")[0] if "." in local.split("@")[-1] else "@" + local]
    d = digits(s)
    return [d, "~" + d[-9:]] if len(d) >= 9 else [d]


class Graph:
    """The chunks of many documents as one factor graph of separate parts."""

    def __init__(self):
        self.features: list[list[int]] = []
        self.label: list[int] = []
        self.edges: list[tuple[int, int, int]] = []  # node, later node, 0 neighbour or 1 alike

    def add(self, text: str, parts: list[tuple[int, int, int]]) -> None:
        first, end = len(self.label), None
        base: dict[str, list[tuple[int, int]]] = {}  # key, then place and node of the base spans that have it
        bare = []
        for k, (label, a, b) in enumerate(parts):
            n = first + k
            self.features.append(features(text, a, b))
            self.label.append(label)
            if end is not None and a - end <= 80:
                self.edges.append((n - 1, n, 0))
            end = b
            if label == OTHER:
                bare.append((n, a, b))
                continue
            linked = set()
            for key in keys(text, a, b):
                some = base.setdefault(key, [])
                if some and some[-1][1] not in linked:
                    linked.add(some[-1][1])
                    self.edges.append((some[-1][1], n, 1))
                some.append((a, n))
        # a bare chunk hangs on the nearest base span with its key, before or after it; other bare chunks have no say
        for n, a, b in bare:
            near = set()
            for key in keys(text, a, b):
                if some := base.get(key):
                    at = bisect.bisect(some, (a, n))
                    near.add(min(some[max(0, at - 1) : at + 1], key=lambda x: abs(x[0] - a))[1])
            self.edges += [(min(m, n), max(m, n), 1) for m in near]

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """(node, feature) of all features."""
        sizes = np.fromiter(map(len, self.features), np.int64, len(self.features))
        return np.repeat(np.arange(len(sizes)), sizes), np.fromiter((f for x in self.features for f in x), np.int64, int(sizes.sum()))

    def pairs(self) -> np.ndarray:
        return np.array(self.edges, np.int64).reshape(-1, 3)


def summed(w: np.ndarray, own: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(own, w[feature, k], n) for k in range(LABELS)], axis=1)


def bounded(z: np.ndarray) -> np.ndarray:
    """Node potentials within EVIDENCE of each other's middle."""
    return EVIDENCE * np.tanh((z - z.mean(axis=1, keepdims=True)) / EVIDENCE)


def held_fixed(node: np.ndarray, label: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Node potentials in which the seen labels cannot be turned by any number of ties."""
    node = node.copy()
    node[seen] = -1e9
    node[seen, label[seen]] = 0.0
    return node


def normal(x: np.ndarray) -> np.ndarray:
    """exp(x), each row divided by its sum."""
    flat = x.reshape(len(x), -1)
    e = np.exp(flat - flat.max(axis=1, keepdims=True, initial=-np.inf))
    return (e / e.sum(axis=1, keepdims=True)).reshape(x.shape)


class Messages:
    """Loopy message passing on one factor graph: ``edges`` (from, to, type), ``ties`` log tie tables by type."""

    def __init__(self, edges: np.ndarray, labels: int = LABELS):
        self.edges, half = edges, len(edges)
        self.src, self.dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        self.other = np.concatenate([np.arange(half) + half, np.arange(half)])
        self.message = np.zeros((2 * half, labels))

    def belief(self, node: np.ndarray) -> np.ndarray:
        return node + np.stack([np.bincount(self.dst, self.message[:, k], len(node)) for k in range(node.shape[1])], axis=1) if len(self.edges) else node

    def cavity(self, node: np.ndarray) -> np.ndarray:
        out = self.belief(node)[self.src] - self.message[self.other]
        return out - out.max(axis=1, keepdims=True, initial=-np.inf)

    def settle(self, node: np.ndarray, ties: np.ndarray, rounds: int = 1000) -> np.ndarray:
        """Marginals after passing messages until none changes (``rounds`` times at most)."""
        kind = self.edges[:, 2]
        table = np.exp(np.concatenate([ties[kind], ties[kind].transpose(0, 2, 1)])) if len(kind) else None
        for _ in range(rounds if len(kind) else 0):
            new = np.log(np.einsum("ei,eij->ej", np.exp(self.cavity(node)), table) + 1e-30)
            new -= new.max(axis=1, keepdims=True)
            change = np.abs(new - self.message).max()
            self.message = 0.5 * self.message + 0.5 * new
            if change < 1e-6:
                break
        return normal(self.belief(node))

    def pairs(self, node: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Pair marginals of the edges."""
        half, out = len(self.edges), self.cavity(node)
        return normal(ties[self.edges[:, 2]] + out[:half, :, None] + out[half:, None, :])


def propagate(node: np.ndarray, edges: np.ndarray, ties: np.ndarray, rounds: int = 1000) -> np.ndarray:
    return Messages(edges, node.shape[1]).settle(node, ties, rounds)


def bare(kind: int, s: str) -> str:
    """A mention that no base pattern takes, if there is one."""
    return s.rsplit(".", 1)[0] if KINDS[kind] == "email" else re.sub(r"[^0-9]+", " ", s).strip()


def hidden_mentions(texts: list[str], seed: int, hide: float = 0.2, repeat: float = 0.6) -> tuple[Graph, np.ndarray, np.ndarray]:
    """(graph with the true labels, nodes whose label is seen, nodes that are bare repeats) of texts in which base spans are hidden
    and repeats written at the end, each after a word of the text."""
    rng, g = np.random.default_rng(seed), Graph()
    seen, repeats = [], []
    for t in texts:
        base = base_spans(t)
        words, truth = re.findall(r"[^\W\d_]+", t[-2000:]) or ["x"], {}
        written_ = t
        for k, a, b in base:
            if rng.random() < repeat:
                written_ += f"\n{words[int(rng.integers(len(words)))]} "
                truth[len(written_)] = k
                written_ += bare(k, t[a:b]) + " ."
        parts = chunks(written_, base_spans(written_))
        if not parts:
            continue
        first = len(g.label)
        g.add(written_, parts)
        for n, (label, a, _) in enumerate(parts, first):
            again = label == OTHER and a in truth
            if again:
                g.label[n] = truth[a]
            repeats.append(again)
            seen.append(label != OTHER and rng.random() >= hide)
    return g, np.array(seen, bool), np.array(repeats, bool)


def train(texts: list[str], rounds: int = 150, l2: float = 1e-3, rate: float = 0.4, seed: int = 3) -> dict:
    """Node weights and tie tables together, on hidden mentions."""
    g, seen, repeats = hidden_mentions(texts, seed)
    w = np.zeros((FEATURES, LABELS))
    start = np.stack([np.zeros((LABELS, LABELS)), 6.0 * np.eye(LABELS)])
    start[1][OTHER, OTHER] = 0.0
    ties = start.copy()
    y = np.array(g.label, np.int64)
    asked = ~seen if len(y) else np.zeros(0, bool)
    if not asked.any():
        return {"w": w, "ties": ties}
    n, edges = len(y), g.pairs()
    own, feature = g.flat()
    against = np.flatnonzero(repeats)[::2]
    truth = np.eye(LABELS)[y]
    live = asked[edges[:, 0]] | asked[edges[:, 1]]
    pair_truth = truth[edges[:, 0]][:, :, None] * truth[edges[:, 1]][:, None, :]
    passing = Messages(edges)
    gw, gt = np.full_like(w, 1e-8), np.full_like(ties, 1e-8)
    for _ in range(rounds):
        z = summed(w, own, feature, n)
        u = bounded(z)
        turned = np.ones(n)
        u[against], turned[against] = -EVIDENCE, 0.0
        u[against, OTHER] = EVIDENCE
        node = held_fixed(u, y, seen)
        p = passing.settle(node, ties, rounds=12)
        # through the bound and the centring, to the weights
        du = np.where(asked[:, None], truth - p, 0.0) * turned[:, None] * (1 - (u / EVIDENCE) ** 2)
        dz = (du - du.mean(axis=1, keepdims=True)) / asked.sum()
        grad = np.stack([np.bincount(feature, dz[own, k], FEATURES) for k in range(LABELS)], axis=1) - l2 * w / n
        gw += grad**2
        w += rate * grad / np.sqrt(gw)
        if live.any():
            off = (pair_truth - passing.pairs(node, ties)) * live[:, None, None]
            step = np.zeros_like(ties)
            np.add.at(step, edges[:, 2], off)
            step[1] = (step[1] + step[1].T) / 2  # which of two alike chunks comes first says nothing
            step = step / live.sum() - l2 * (ties - start) / n
            gt += step**2
            ties += rate * step / np.sqrt(gt)
    return {"w": w, "ties": ties}


def recovery(texts: list[str], model: dict, sure: float = 0.9, seed: int = 9) -> dict:
    """Of bare repeats and hidden base spans in texts not learned from: how many are found, and the share of right ones among all
    chunks that are given a kind."""
    g, seen, repeats = hidden_mentions(texts, seed)
    y, n = np.array(g.label, np.int64), len(g.label)
    own, feature = g.flat()
    p = propagate(held_fixed(bounded(summed(model["w"], own, feature, n)), y, seen), g.pairs(), model["ties"])
    best = p[:, :OTHER].argmax(axis=1)
    given = ~seen & (p[np.arange(n), best] >= sure)
    right = given & (best == y)
    return {"repeats": int(repeats.sum()), "found": int((right & repeats).sum()), "given": int(given.sum()), "right": int(right.sum()), "others": int((y == OTHER).sum())}


def fit(docs: DataFrame, n: int = 1500, max_bytes: int = 20_000, key: str = "doc_id") -> dict:
    """Learns from at most ``n`` documents of at most ``max_bytes`` each, chosen by a hash of the id among those that hold a
    digit or an at-sign."""
    ids = docs.where(F.col(key).isNotNull()).select(key).orderBy(F.xxhash64(key), key).limit(2 * n).collect()
    if not ids:
        return train([])
    small = F.broadcast(docs.sparkSession.createDataFrame([tuple(r) for r in ids], docs.select(key).schema).dropDuplicates([key]))
    rows = docs.select(key, "text").where((F.octet_length("text") <= max_bytes) & F.col("text").rlike("[0-9@]")).join(small, key).collect()
    return train([r["text"] for r in sorted(rows, key=lambda r: (r[key], r["text"]))][:n])


def find(texts: list[str], flagged: list[bool], model: dict, sure: float = 0.9) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text."""
    g, out, where = Graph(), [], []
    for t, f in zip(texts, flagged, strict=True):
        base = base_spans(t) if f else []
        parts = chunks(t, base) if f else []
        out.append((base, []))
        # a document without a candidate beside its base spans can gain nothing
        if any(label == OTHER for label, _, _ in parts):
            where += [(len(out) - 1, a, b) for _, a, b in parts]
            g.add(t, parts)
    if where:
        label = np.array(g.label)
        own, feature = g.flat()
        node = bounded(summed(model["w"], own, feature, len(label)))
        p = propagate(held_fixed(node, label, label != OTHER), g.pairs(), model["ties"])
        best = p[:, :OTHER].argmax(axis=1)
        for n in np.flatnonzero((label == OTHER) & (p[np.arange(len(p)), best] >= sure)).tolist():
            d, a, b = where[n]
            out[d][1].append((int(best[n]), a, b))
    return out


def detect(docs: DataFrame, model: dict, key: str = "doc_id") -> DataFrame:
    """Spans of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for big in batches:
            for b in slices(big, "text"):
                col = pc.fill_null(b.column("text"), "")
                flagged = pc.match_substring_regex(col, "[0-9@]").to_pylist()
                texts = col.to_pylist()
                found = find(texts, flagged, m)
                cols = [[sum(k == n for k, _, _ in base) for base, _ in found] for n in range(4)]
                digest = [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found]
                every = [sorted(base + added) for base, added in found]
                out = [b.column(key), *(pa.array(c, pa.int64()) for c in cols), pa.array(digest), pa.array([written(x) for x in every]), pa.array([len(a) for _, a in found], pa.int64()), pa.array(list(map(len, every)), pa.int64())]
                names = [key, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_spans"]
                yield pa.RecordBatch.from_arrays(out, names)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"
    return docs.select(key, "text").mapInArrow(run, schema)


def redacted(docs: DataFrame, model: dict) -> DataFrame:
    """The rows with every span in ``text`` replaced by its kind in brackets, and ``n_chars``, if there is one, counted anew."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for big in batches:
            for b in slices(big, "text"):
                given = b.column("text").to_pylist()
                texts = [t or "" for t in given]
                flagged = pc.match_substring_regex(pc.fill_null(b.column("text"), ""), "[0-9@]").to_pylist()
                found = find(texts, flagged, m)
                new = [None if g is None else blank(t, x + y) for g, t, (x, y) in zip(given, texts, found, strict=True)]
                cols = dict(zip(b.schema.names, b.columns, strict=True)) | {"text": pa.array(new, pa.string())}
                if "n_chars" in cols:
                    sizes = pa.array([None if t is None else len(t) for t in new], pa.int64()).cast(cols["n_chars"].type)
                    cols["n_chars"] = pc.if_else(cols["n_chars"].is_valid(), sizes, cols["n_chars"])
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return docs.mapInArrow(run, docs.schema)


def blank(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def op7_pii(docs: DataFrame) -> DataFrame:
    return detect(docs, fit(docs))
