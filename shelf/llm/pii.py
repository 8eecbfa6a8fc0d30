r"""Personal data: fixed patterns plus a character-level BiLSTM-CRF written in numpy.

The tagger reads characters in both directions, a linear layer gives emissions for BIO tags
of four kinds, and a CRF holds the transitions. It is trained from labelled spans in
generated text (bounded, seeded, the same in every run). Texts are read whole: stretches
around digits and at-signs, without which no kind can occur, are cut into overlapping
windows; the windows' emissions are blended with weights that fall towards their edges, and
one Viterbi pass over each stretch reconciles them.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from shelf.llm.common import bounded

#: Kinds in their order, and the patterns of the base spans.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: What a stretch of text must hold to be read by the tagger, and how far around it.
_TRIGGER = re.compile(r"[0-9@]|[\[(]at[\])]")
REACH = 40
#: Characters that are scored at a time.
GROUP = 400_000
WINDOW, STRIDE = 96, 48
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
EMBED, HIDDEN = 12, 20
#: Bounds of training: generated windows and their length.
TRAIN_WINDOWS, TRAIN_LENGTH, EPOCHS, BATCH, RATE, SEED = 6000, 64, 4, 32, 0.015, 11


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the fixed patterns, leftmost and non-overlapping for each kind."""
    found = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            last = m.end()
            found.append((start, 0, last))
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


# Labelled text ------------------------------------------------------------------------


def labelled_text(rng: random.Random, length: int = WINDOW) -> tuple[str, list[tuple[int, int, int]]]:
    """A piece of generated prose with the spans of the personal data put into it."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    syllables = "an the er on in es ti re ou éa ch ung keit ión mente ado qu eaux le st or äch ß ñ br".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def personal(kind: int) -> str:
        if kind == 0:
            at = rng.choice(["@"] * 6 + [" [at] ", "(at)", " @ "])
            dot = "." if at == "@" else rng.choice([".", " [dot] "])
            name = word() + rng.choice(["", ".", "_", "-"]) + rng.choice(["", digits(2), word()])
            return name + at + word() + rng.choice(["", digits(1)]) + dot + rng.choice(["example.com", "org", "net", "co.uk", "com"])
        if kind == 1:
            return rng.choice(["."] * 5 + [" . "]).join(str(rng.randint(0, 255)) for _ in range(4))
        if kind == 2:
            sep, body = rng.choice(["", " ", "-", "."]), digits(15)
            number = body + next(d for d in "0123456789" if luhn(body + d))
            return sep.join(number[k : k + 4] for k in range(0, 16, 4))
        form = rng.choice(["+1 ({}) {}-{}", "+{} {} {}", "({}) {}-{}", "+44 {} {} {}", "{}-{}-{}", "+49 {}/{}{}"])
        sizes = [3, 3, 4] if "44" not in form else [4, 3, 4]
        return form.format(*(digits(n) for n in sizes))

    def other() -> str:
        return rng.choice([
            lambda: digits(rng.randint(1, 9)),
            lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 30)}" + rng.choice(["", "."]),
            lambda: f"Version {rng.randint(1, 9)}.0.",
            lambda: f"{rng.randint(1900, 2030)}-{digits(2)}-{digits(2)}",
            lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(20, 44))),
            lambda: 'token = "' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"',
            lambda: "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16)),
            lambda: f"{digits(2)}:{digits(2)}",
            lambda: f"${digits(3)}.{digits(2)}",
            lambda: f"{digits(20)}{digits(rng.randint(0, 9))}",
            lambda: f"@{word()}",
            lambda: f"v{digits(1)}.{digits(1)}.{digits(2)}",
        ])()

    text, spans = "", []
    while len(text) < length:
        roll = rng.random()
        if roll < 0.16:
            kind = rng.randrange(4)
            value = personal(kind)
            spans.append((len(text), kind, len(text) + len(value)))
            text += value
        elif roll < 0.3:
            text += other()
        else:
            text += word()
        text += rng.choice([" "] * 8 + [", ", ". ", "\n", "*** ", " | ", "!! "])
    return text[:length], [(s, k, min(e, length)) for s, k, e in spans if s < length - 4]


def tags_of(spans: list[tuple[int, int, int]], length: int) -> np.ndarray:
    out = np.zeros(length, np.int64)
    for start, kind, end in spans:
        out[start] = 1 + 2 * kind
        out[start + 1 : end] = 2 + 2 * kind
    return out


# Tagger -------------------------------------------------------------------------------

#: Ids of characters: 0 pads, ASCII is its code point plus one, then the ids of classes.
_OTHER_LETTER, _OTHER, _VOCABULARY = 129, 130, 131
_ASCII = np.arange(1, 129)
_ASCII[48:58] = _ASCII[48]  # one id for all digits
_ASCII[65:91] = _ASCII[65]  # one id for capitals


def char_ids(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    out = _ASCII[np.minimum(codes, 127)]
    for at in np.flatnonzero(codes >= 128).tolist():
        out[at] = _OTHER_LETTER if chr(codes[at]).isalpha() else _OTHER
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


class Tagger:
    """BiLSTM emissions with CRF transitions; parameters are a dict of float32 arrays."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Tagger:
        shape = {"embed": (_VOCABULARY, EMBED), "out": (2 * HIDDEN, len(TAGS)), "bias": (len(TAGS),), "move": (len(TAGS), len(TAGS)), "first": (len(TAGS),)}
        for side in "fb":
            shape |= {f"x{side}": (EMBED, 4 * HIDDEN), f"h{side}": (HIDDEN, 4 * HIDDEN), f"c{side}": (4 * HIDDEN,)}
        params = {k: (rng.standard_normal(s) * (0.25 if len(s) == 2 else 0.0)).astype(np.float32) for k, s in shape.items()}
        params["embed"][98:124] = params["embed"][98] + 0.1 * params["embed"][98:124]  # small letters start alike
        for side in "fb":
            params[f"c{side}"][HIDDEN : 2 * HIDDEN] = 1.0  # open forget gates
        return cls(params)

    def _read(self, x: np.ndarray, side: str, keep: list | None) -> np.ndarray:
        """Hidden states of one direction for embedded windows ``(steps, batch, EMBED)``."""
        steps, batch = x.shape[:2]
        gates = x @ self.p[f"x{side}"] + self.p[f"c{side}"]
        back = self.p[f"h{side}"]
        h, c = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
        out = np.empty((steps, batch, HIDDEN), np.float32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = gates[t] + h @ back
            s = _sigmoid(z[:, : 3 * HIDDEN])
            g = np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            before, c = c, f * c + i * g
            tc = np.tanh(c)
            if keep is not None:
                keep.append((t, h, before, i, f, o, g, tc))
            h = o * tc
            out[t] = h
        return out

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """Tag scores ``(windows, steps, tags)`` of windows of character ids."""
        x = self.p["embed"][ids.T]
        both = np.concatenate([self._read(x, s, None) for s in "fb"], 2)
        return (both @ self.p["out"] + self.p["bias"]).transpose(1, 0, 2)

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags, and its gradients."""
        x = self.p["embed"][ids.T]
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._read(x, s, kept[s]) for s in "fb"], 2)
        scores = both @ self.p["out"] + self.p["bias"]
        steps, batch, k = scores.shape
        move, gold = self.p["move"], tags.T
        ahead, behind = np.empty_like(scores), np.zeros_like(scores)
        ahead[0] = self.p["first"] + scores[0]
        for t in range(1, steps):
            ahead[t] = scores[t] + _logsum(ahead[t - 1][:, :, None] + move, 1)
        for t in range(steps - 2, -1, -1):
            behind[t] = _logsum(move + (scores[t + 1] + behind[t + 1])[:, None, :], 2)
        whole = _logsum(ahead[-1], 1)
        share = np.exp(ahead + behind - whole[None, :, None])
        pair = ahead[:-1, :, :, None] + move + (scores[1:] + behind[1:])[:, :, None, :] - whole[None, :, None, None]
        g = {"move": np.exp(pair).sum((0, 1))}
        np.add.at(g["move"], (gold[:-1].ravel(), gold[1:].ravel()), -1.0)
        d = share.copy()
        np.put_along_axis(d, gold[:, :, None], np.take_along_axis(d, gold[:, :, None], 2) - 1.0, 2)
        path = np.take_along_axis(scores, gold[:, :, None], 2).sum((0, 2)) + move[gold[:-1], gold[1:]].sum(0) + self.p["first"][gold[0]]
        g |= {"first": d[0].sum(0), "bias": d.sum((0, 1)), "out": np.einsum("tbh,tbk->hk", both, d)}
        dboth, dx = d @ self.p["out"].T, np.zeros_like(x)
        for n, side in enumerate("fb"):
            dh, dc = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
            wx, wh = self.p[f"x{side}"], self.p[f"h{side}"]
            gx, gh, gc = np.zeros_like(wx), np.zeros_like(wh), np.zeros(4 * HIDDEN, np.float32)
            for t, h, before, i, f, o, cand, tc in reversed(kept[side]):
                dh = dh + dboth[t, :, n * HIDDEN : (n + 1) * HIDDEN]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * cand * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - cand * cand)], 1)
                gx += x[t].T @ dz
                gh += h.T @ dz
                gc += dz.sum(0)
                dx[t] += dz @ wx.T
                dh, dc = dz @ wh.T, dc * f
            g |= {f"x{side}": gx, f"h{side}": gh, f"c{side}": gc}
        g["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(g["embed"], ids.T, dx)
        return float((whole - path).mean()), {name: v / batch for name, v in g.items()}

    def viterbi(self, scores: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """Best tags of padded stretches ``(batch, steps, tags)``; I may only follow its own kind."""
        allowed = np.array([[not b.startswith("I") or a[2:] == b[2:] for b in TAGS] for a in TAGS])
        move = np.where(allowed, self.p["move"], -1e4)
        first = np.where([t.startswith("I") for t in TAGS], -1e4, self.p["first"])
        best, back, at_end = first + scores[:, 0], np.zeros(scores.shape, np.int8), {}
        for t in range(scores.shape[1]):
            if t:
                options = best[:, :, None] + move
                back[:, t] = options.argmax(1)
                best = options.max(1) + scores[:, t]
            for row in np.flatnonzero(lengths == t + 1):
                at_end[int(row)] = int(best[row].argmax())
        out = []
        for row, n in enumerate(lengths.tolist()):
            tags = np.zeros(n, np.int64)
            tags[-1] = at_end[row]
            for t in range(n - 1, 0, -1):
                tags[t - 1] = back[row, t, tags[t]]
            out.append(tags)
        return out


@cache
def trained(windows: int = TRAIN_WINDOWS, epochs: int = EPOCHS, seed: int = SEED) -> Tagger:
    """Train by Adam on ``windows`` generated windows; once for each process."""
    rng, draw = random.Random(seed), np.random.default_rng(seed)
    texts = [labelled_text(rng, TRAIN_LENGTH) for _ in range(windows)]
    ids = np.stack([char_ids(t) for t, _ in texts])
    tags = np.stack([tags_of(s, TRAIN_LENGTH) for _, s in texts])
    model = Tagger.fresh(draw)
    one = {k: np.zeros_like(v) for k, v in model.p.items()}
    two = {k: np.zeros_like(v) for k, v in model.p.items()}
    total, step = epochs * -(-windows // BATCH), 0
    for _ in range(epochs):
        order = draw.permutation(windows)
        for at in range(0, windows, BATCH):
            some = order[at : at + BATCH]
            _, grads = model.gradients(ids[some], tags[some])
            norm = np.sqrt(sum(float((v * v).sum()) for v in grads.values()))
            step += 1
            rate = RATE * (1 - 0.9 * step / total) * min(1.0, 5.0 / (norm + 1e-9))
            for k, v in grads.items():
                one[k] = 0.9 * one[k] + 0.1 * v
                two[k] = 0.99 * two[k] + 0.01 * v * v
                model.p[k] -= (rate * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


# Whole texts --------------------------------------------------------------------------


def stretches(text: str) -> list[tuple[int, int]]:
    """Maximal pieces of a text within ``REACH`` characters of a trigger, ends of words included.

    No word is cut, so a span of any length lies in one piece.
    """
    out: list[tuple[int, int]] = []
    for m in _TRIGGER.finditer(text):
        if out and m.end() + REACH <= out[-1][1]:
            continue
        start, end = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and start <= out[-1][1]:
            start = out[-1][0]
        else:
            while start and not text[start - 1].isspace() and not (out and start <= out[-1][1]):
                start -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


_FADE = 1.0 - np.abs(np.arange(WINDOW) - (WINDOW - 1) / 2) / (WINDOW / 2 + 1)


def blended(model: Tagger, pieces: list[str]) -> list[np.ndarray]:
    """Emissions of each piece, blended over its overlapping windows."""
    ids = [char_ids(p) for p in pieces]
    place, windows = [], []
    for n, x in enumerate(ids):
        for start in range(0, max(1, len(x) - WINDOW + STRIDE), STRIDE):
            place.append((n, start))
            windows.append(np.pad(x[start : start + WINDOW], (0, max(0, WINDOW - len(x) + start))))
    out = [np.zeros((len(x), len(TAGS))) for x in ids]
    weight = [np.zeros((len(x), 1)) for x in ids]
    for at in range(0, len(windows), 512):
        scores = model.emissions(np.stack(windows[at : at + 512]))
        for (n, start), s in zip(place[at : at + 512], scores, strict=True):
            size = min(WINDOW, len(ids[n]) - start)
            out[n][start : start + size] += s[:size] * _FADE[:size, None]
            weight[n][start : start + size] += _FADE[:size, None]
    return [o / w for o, w in zip(out, weight, strict=True)]


def fits(kind: int, value: str) -> bool:
    """Whether a decoded span holds what its kind cannot do without."""
    digits = sum(c in "0123456789" for c in value)
    if kind == 0:
        return len(value) >= 6 and bool(re.search(r"[^\s@]\s?(@|[\[(]at[\])])\s?[^\s@]", value)) and ("." in value or "dot" in value)
    if kind == 1:
        parts = re.findall(r"[0-9]+", value)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 14 <= digits <= 19 and not re.search(r"[A-Za-z]", value) and luhn(re.sub("[^0-9]", "", value))
    return 10 <= digits <= 15 and not re.search(r"[A-Za-z]", value) and bool(re.search(r"[^0-9]", value))


def decoded(model: Tagger, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Spans that the tagger finds in whole texts, ends trimmed of white space.

    Stretches are scored in groups of ``GROUP`` characters, which bounds the memory of a
    batch; one longer stretch is a group of its own.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    group, held = [], 0
    for n, t in enumerate(texts):
        for a, b in stretches(t):
            if group and held + b - a > GROUP:
                _decode(model, texts, group, out)
                group, held = [], 0
            group.append((n, a, b))
            held += b - a
    if group:
        _decode(model, texts, group, out)
    return out


def _decode(model: Tagger, texts: list[str], where: list[tuple[int, int, int]], out: list[list[tuple[int, int, int]]]) -> None:
    """Add the spans of some stretches ``(text, start, end)`` to their texts' lists."""
    scores = blended(model, [texts[n][a:b] for n, a, b in where])
    order = sorted(range(len(where)), key=lambda i: len(scores[i]))
    at = 0
    while at < len(order):
        size = 1
        while at + size < len(order) and (size + 1) * len(scores[order[at + size]]) <= 60_000:
            size += 1
        some = order[at : at + size]
        at += size
        lengths = np.array([len(scores[i]) for i in some])
        padded = np.zeros((len(some), lengths.max(), len(TAGS)))
        for row, i in enumerate(some):
            padded[row, : lengths[row]] = scores[i]
        for i, tags in zip(some, model.viterbi(padded, lengths), strict=True):
            n, offset, _ = where[i]
            begins = np.flatnonzero(tags % 2 == 1)
            for b in begins.tolist():
                kind, e = int(tags[b] - 1) // 2, b + 1
                while e < len(tags) and tags[e] == tags[b] + 1:
                    e += 1
                value = texts[n][offset + b : offset + e]
                start = offset + b + len(value) - len(value.lstrip())
                value = value.strip()
                if fits(kind, value):
                    out[n].append((start, kind, start + len(value)))


def find(model: Tagger, texts: list[str]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Base spans and added spans of each text; added ones overlap no base span."""
    found = []
    for text, spans in zip(texts, decoded(model, texts), strict=True):
        base = base_spans(text)
        added = [s for s in spans if not any(s[0] < e and b < s[2] for b, _, e in base)]
        found.append((base, sorted(added)))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """Personal data of every whole text: ``doc_id``, counts and digest of base spans, all spans.

    Null and empty texts have no spans; long ones are read whole. Rows are treated each by itself, so repeated rows
    give equal results; columns besides ``doc_id, text`` are not read. An empty table gives
    an empty result.
    """
    model = model or trained()
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            found = find(model, [t or "" for t in batch.column(1).to_pylist()])
            counts = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(4)]
            digests = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string())
            spans = pa.array([joined(sorted(base + added)) for base, added in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, spans], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
