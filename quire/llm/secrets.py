"""Secret scans: patterns, and a character convolutional network over every other candidate."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.sampling import least_hashed
from quire.plans.storage import durable

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: What the network looks at: all runs of such characters, from the length of the shortest secret on.
SHORTEST = min(LEAST.values())
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{SHORTEST},}}")
#: Characters before a candidate, of it (longer ones are read in pieces), and after it.
BEFORE, BODY, AFTER = 20, 44, 8
WIDTH = BEFORE + BODY + AFTER
#: Candidates have a threshold by length: below the first of these, below the second, from it on (more than one piece).
SIZES = np.array([24, BODY + 1])

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the patterns' matches, leftmost and non-overlapping for each kind."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """Runs that the patterns have not found, or not all of; ``taken``: their spans in the order of the starts."""
    out, i, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        at = max(m.start(), reach)  # what lies before is covered by spans that start before the run
        while i < len(taken) and taken[i][0] <= at:
            reach = max(reach, taken[i][1])
            at, i = max(at, reach), i + 1
        if at < m.end():
            out.append(m.span())
    return out


#: Classes of characters: printable ASCII one each, white space, other, and what lies beyond the text.
SPACE, OTHER, OUTSIDE, CLASSES = 96, 97, 98, 99
_ASCII = np.full(128, OTHER)
_ASCII[33:127] = np.arange(94)
_ASCII[[9, 10, 11, 12, 13, 32]] = SPACE


def encode(text: str, start: int, end: int) -> np.ndarray:
    """Rows of character classes around pieces of text[start:end] that cover all of it; the last piece of a longer one is whole, too."""
    rows = []
    for a in [*range(start, end - BODY, BODY), max(start, end - BODY)]:
        b = min(end, a + BODY)
        left, right = text[max(0, a - BEFORE) : a], text[b : b + AFTER]
        row = np.full(WIDTH, OUTSIDE)
        for at, part in ((BEFORE - len(left), left), (BEFORE, text[a:b]), (BEFORE + BODY, right)):
            codes = np.frombuffer(part.encode("utf-32-le", "replace"), np.uint32)
            row[at : at + len(codes)] = np.where(codes < 128, _ASCII[np.minimum(codes, 127)], OTHER)
        rows.append(row)
    return np.array(rows)


class CharacterCnn:
    """Embedding, one convolution, greatest value over positions, logistic output; trained by Adam."""

    def __init__(self, embed: int = 8, filters: int = 24, width: int = 5, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.width = width
        self.p = {"e": rng.normal(0, 0.3, (CLASSES, embed)), "w": rng.normal(0, 0.2, (width * embed, filters)), "b": np.zeros(filters), "v": rng.normal(0, 0.2, 2 * filters), "c": np.zeros(1)}
        self.scale, self.shift, self.cut, self.cuts = 1.0, 0.0, 0.5, np.full(len(SIZES) + 1, 0.5)

    def _forward(self, x: np.ndarray):
        e = self.p["e"][x]
        n, positions = len(x), WIDTH - self.width + 1
        cols = np.concatenate([e[:, i : i + positions] for i in range(self.width)], axis=2)
        h = cols.reshape(n * positions, -1) @ self.p["w"]
        h = np.maximum(h.reshape(n, positions, -1) + self.p["b"], 0)
        inside = slice(BEFORE, BEFORE + BODY)  # what the candidate and what its surroundings hold
        best = np.concatenate([h[:, inside].argmax(1) + BEFORE, h[:, :BEFORE].argmax(1)], axis=1)
        f = h.shape[2]
        which = np.concatenate([np.arange(f), np.arange(f)])
        pooled = h[np.arange(n)[:, None], best, which]
        return cols, best, which, pooled, pooled @ self.p["v"] + self.p["c"][0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 512])[-1] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.shift, -40, 40)))

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.005) -> None:
        rng = np.random.default_rng(5)
        m, v, t = {k: 0 * p for k, p in self.p.items()}, {k: 0 * p for k, p in self.p.items()}, 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                at = order[i : i + batch]
                cols, best, which, pooled, z = self._forward(x[at])
                d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[at]) / len(at)
                back = d[:, None] * self.p["v"] * (pooled > 0)
                rows = np.arange(len(at))[:, None]
                patch = cols[rows, best]  # n x 2 filters x width*embed
                gw = np.zeros_like(self.p["w"])
                np.add.at(gw.T, which, (back[:, :, None] * patch).sum(0))
                ge = np.zeros_like(self.p["e"])
                to_e = (back[:, :, None] * self.p["w"].T[which]).reshape(len(at), len(which), self.width, -1)
                for j in range(self.width):
                    np.add.at(ge, x[at][rows, best + j], to_e[:, :, j])
                g = {"e": ge, "w": gw, "b": np.bincount(which, back.sum(0)), "v": pooled.T @ d, "c": np.array([d.sum()])}
                t += 1
                for k in self.p:
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float, own: np.ndarray | None = None, sizes: np.ndarray | None = None) -> None:
        """Platt scaling of pieces, then the greatest cuts that find the share ``recall`` of the positive findings, of all and of each length.

        ``own``: the finding of each piece (without it each is one), numbered from 0 on, in order; ``sizes``: the lengths of the findings.
        A finding's score is its greatest; a length without positives has the cut of all.
        """
        z = self.logits(x)
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -40, 40)))
            self.scale = max(0.05, self.scale - 0.5 * ((p - y) * z).mean())
            self.shift -= 0.5 * (p - y).mean()
        own = np.arange(len(x)) if own is None else own
        best, secret = np.zeros(own.max(initial=-1) + 1), np.zeros(own.max(initial=-1) + 1, bool)
        np.maximum.at(best, own, self.scores(x))
        secret[own[y > 0]] = True
        at_least = lambda s: float(np.sort(s)[int(len(s) * (1 - recall))])
        self.cut = at_least(best[secret]) if secret.any() else 1.0
        self.cuts = np.full(len(SIZES) + 1, self.cut)
        if sizes is not None:
            for c in range(len(self.cuts)):
                mine = best[secret & (np.searchsorted(SIZES, sizes, "right") == c)]
                self.cuts[c] = at_least(mine) if len(mine) else self.cut

    def found(self, text: str, spans: list[tuple[int, int]]) -> list[bool]:
        """Which of some spans of a text are secrets: their greatest scores, held against the cuts of their lengths."""
        rows = [encode(text, a, b) for a, b in spans]
        best = np.maximum.reduceat(self.scores(np.concatenate(rows)), np.cumsum([0, *map(len, rows[:-1])]))
        return (best >= self.cuts[np.searchsorted(SIZES, [b - a for a, b in spans], "right")]).tolist()


def made_findings(n: int, seed: int = 7, without: tuple[int, ...] = (), only: tuple[int, ...] = ()) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label) of made findings: keys of well-known shapes, and harmless runs that resemble them.

    Shapes of keys, by number, can be left out, or be the only ones, to see how a network does on shapes that it was not shown.
    """
    rng = np.random.default_rng(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    pick = lambda chars, k: "".join(rng.choice(list(chars), k))
    word = lambda: pick("aeioulnrst", 2) + pick(lower, int(rng.integers(1, 6)))
    mixed = lower + upper + digits
    secret = [
        lambda: "ghp_" + pick(mixed, 36), lambda: "AIza" + pick(mixed + "_-", 35), lambda: f"xoxb-{pick(digits, 12)}-{pick(mixed, 24)}",
        lambda: "eyJ" + pick(mixed, 18) + "." + pick(mixed + "_-", 40) + "." + pick(mixed + "_-", 30), lambda: pick(mixed + "+/", int(rng.integers(24, 64))),
        lambda: "sk_live_" + pick(mixed, 24), lambda: pick(mixed, int(rng.integers(20, 48))) + "==", lambda: pick(upper + digits, int(rng.integers(20, 40))),
        lambda: pick(mixed, int(rng.integers(SHORTEST, 24))), lambda: pick(lower + upper, int(rng.integers(SHORTEST, 24))), lambda: word() + "_" + pick("0123456789abcdef", 16) + pick(mixed, 6),
    ]
    harmless = [
        lambda: f"{word()}{pick(digits, 1)}.example.{pick(lower, 3)}", lambda: f"{word()}.{word()}-{pick(digits, 2)}.html", lambda: f"{word()}_{word()}_{word()}_{pick(digits, 2)}",
        lambda: f"20{pick(digits, 2)}-{pick(digits, 2)}-{pick(digits, 2)}T{pick(digits, 2)}-{pick(digits, 2)}-{pick(digits, 2)}", lambda: f"{word()}/{word()}/{word()}{pick(digits, 1)}/{word()}",
        lambda: "-".join(word() for _ in range(4)) + pick(digits, 2), lambda: ".".join(pick(digits, 3) for _ in range(5)), lambda: "-" * int(rng.integers(12, 30)) + pick(digits, 4),
        lambda: f"www.{word()}{word()}.com/{word()}/{pick(digits, 3)}", lambda: word() + word() + word() + word() + word() + pick(digits, 1), lambda: f"v{pick(digits, 1)}.{pick(digits, 2)}.{pick(digits, 2)}-{word()}-{word()}",
        lambda: word() + word() + word() + word(), lambda: (word() + word() + word()).capitalize() + str(rng.choice(["", ".", "..."])), lambda: (word() + word() + word() + word()).upper(),
        lambda: "-".join(word() for _ in range(3)), lambda: f"{word()}/{word()}/{word()}.{word()}", lambda: str(rng.choice(list("-=._+/"))) * int(rng.integers(SHORTEST, 60)),
        lambda: word().capitalize() + word().capitalize() + word().capitalize(),
    ]
    secret = [shape for i, shape in enumerate(secret) if i not in without and (not only or i in only)]
    out = []
    for i in range(n):
        label = i % 2
        made = (secret if label else harmless)[int(rng.integers(len(secret if label else harmless)))]()
        if len(made) < SHORTEST:
            made += ("-" + word() + word() + word())[: max(2, SHORTEST - len(made))]
        left = " ".join(word() for _ in range(4)) + str(rng.choice([" ", " key ", " at ", " in ", ": ", " = ", " \""]))
        text = left + made + str(rng.choice([" ", ". ", "\n", "\" "])) + word()
        out.append((text, len(left), len(left) + len(made), label))
    return out


#: Runs that are no secrets as they stand in texts: words with marks between them, numbers, and rows of one mark.
HARMLESS = re.compile(r"[A-Z]?[a-z]*(?:[-_/.=+][A-Z]?[a-z]*)*+|[0-9./=+_-]+|(.)\1*")


def _findings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled findings of texts, in pieces: the patterns' values are positive but for numbers, and runs of words and marks are harmless."""
    for batch in batches:
        x, y = [], []
        for text in batch.column("text").to_pylist():
            spans = base_spans(text or "")
            found = [(text.rfind(" ", a, b) + 1 or a if kind == "assign" else a, b, not text[a:b].isdigit()) for a, b, kind in spans]
            found += [(a, b, False) for a, b in candidates(text or "", spans) if HARMLESS.fullmatch(text, a, b)]
            for a, b, secret in found:
                pieces = encode(text, a, b).astype(np.uint8)
                x += [p.tobytes() for p in pieces]
                y += [int(secret)] * len(pieces)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.int32())], names=["x", "y"])


def train_scanner(docs: DataFrame, *, sample: int = 2000, per_label: int = 2000, made: int = 4000, recall: float = 0.98, without: tuple[int, ...] = ()) -> CharacterCnn:
    """A network trained on ``made`` made findings, whole, and on at most ``per_label`` pieces of secret and as many of harmless ones in at most ``sample`` documents, of least hash.

    A quarter of the findings sets the thresholds, one for each length of candidates, so that the share ``recall`` of the secret ones is found;
    it is 0.98 because shapes of keys that were not shown are found less often than those that were.
    Documents without id or text teach nothing; without findings in them the made ones do. ``without``: shapes of made keys that are left out.
    """
    ids = durable(least_hashed(docs.select("doc_id").where("doc_id is not null").distinct(), sample, "doc_id"), "secret-ids")
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text").mapInArrow(_findings, "x binary, y int")
    found = durable(found.distinct(), "secret-findings")
    found = least_hashed(found.where("y = 1"), per_label, "x", "y").unionByName(least_hashed(found.where("y = 0"), per_label, "x", "y")).orderBy("y", "x").toArrow()
    rows = [(encode(t, a, b), label, b - a) for t, a, b, label in made_findings(made, without=without)]
    for x, y in zip(found.column("x").to_pylist(), found.column("y").to_pylist(), strict=True):
        piece = np.frombuffer(x, np.uint8)
        rows.append((piece[None].astype(np.int64), y, int((piece[BEFORE : BEFORE + BODY] != OUTSIDE).sum())))
    x, own = np.concatenate([r for r, _, _ in rows]), np.repeat(np.arange(len(rows)), [len(r) for r, _, _ in rows])
    y, sizes = np.array([label for _, label, _ in rows], float), np.array([size for *_, size in rows])
    learn = np.random.default_rng(11).random(len(rows)) < 0.75
    net = CharacterCnn()
    net.train(x[learn[own]], y[own][learn[own]])
    kept = own[~learn[own]]
    net.calibrate(x[~learn[own]], y[kept], recall, np.unique(kept, return_inverse=True)[1], sizes[~learn])
    return net


def all_spans(text: str, net: CharacterCnn) -> list[Span]:
    base = base_spans(text)
    more = candidates(text, base)
    if more:
        base = sorted([*base, *((a, b, "model") for (a, b), secret in zip(more, net.found(text, more), strict=True) if secret)], key=lambda s: (s[0], KINDS.index(s[2])))
    return base


SPANS = "array<struct<start:long,end:long,kind:string>>"


def scan(docs: DataFrame, net: CharacterCnn) -> DataFrame:
    """doc_id, text and ``found``: the spans (code points, end exclusive) of secrets in every whole text.

    Null texts have none and stay null; repeated rows are scanned alike; other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for batch in batches:
            found = [[dict(zip(("start", "end", "kind"), s, strict=True)) for s in all_spans(t, net)] if t else [] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "found"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, found {SPANS}")


def redact(docs: DataFrame, net: CharacterCnn, mark: str = "[secret]") -> DataFrame:
    """All columns of ``docs``; in ``text`` every found span, overlapping ones together, is replaced by ``mark``, and ``n_chars`` follows."""

    def hide(text: str | None) -> str | None:
        at, out = 0, []
        for a, b, _ in all_spans(text, net) if text else []:
            if b > at:
                if a >= at:
                    out += [text[at:a], mark]
                at = b
        return "".join(out) + text[at:] if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index("text")
            yield batch.set_column(i, "text", pa.array([hide(t) for t in batch.column(i).to_pylist()], pa.string()))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``scan``: null and empty texts have no spans, repeated rows each have their own, ids may be null."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs, train_scanner(docs))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(joined(F.filter("found", lambda s: s["kind"] != "model")), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"),
    )
