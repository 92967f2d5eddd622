"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

``base_spans`` finds e-mail addresses, IP addresses, card and phone numbers by their patterns.
The model is trained in numpy from labelled spans of the documents themselves: base spans, and
values assigned to a token, key or password, each with the words around it (``labelled``, a
sample bounded by FIT_DOCUMENTS and FIT_PIECES). In training, spans are drawn with other digits
and letters and are often written in ways that the patterns do not match, so the model adds what
they miss. Base spans always stay; an added one overlaps none of them. Secrets are the model's
alone, and are reported apart from the four kinds.

The model reads every character, in windows of 256 that start every 224. Where windows overlap,
their emissions are averaged, weighted towards each window's middle, and one Viterbi path is
taken over the whole text, so a span is decided once however many windows saw it. The path is
outside for sure wherever no run of characters can gain what leaving and coming back cost
(``doubtful``, a bound, so nothing is lost); runs in doubt are decoded many at a time, end to end
with a place outside between them: the whole row is cut in pieces that are scored side by side
from guessed beginnings, and a piece whose guess the end of the piece before does not bear out
is scored again, until all agree. Memory follows the longest text. How a span is written is up
to the model; ``holds`` checks its value only: 12 to 19 digits passing Luhn, 9 to 15 digits,
four numbers of at most 255, a name, an at and a domain, or 16 letters and digits.

Offsets are code points, ends exclusive. Nulls and odd input: a null text counts as empty and
has no spans; repeated rows are searched one by one; a null doc_id is kept; where the sample
holds no labelled span (an empty table is one case) nothing is learned and only base spans are
found; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The kinds in the order that breaks ties, and their patterns.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only begin where digits begin, and stating so keeps long runs of digits linear.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: Labels of secrets to learn from: what is assigned to a name that says so.
SECRET = re.compile(r"(?i)(?:token|secret|key|passwd|password)[\"']?[ \t]*[:=][ \t]*[\"']?([A-Za-z0-9_+/=-]{16,})")
#: What the model tells apart.
LEARNED = (*KINDS, "secret")
#: Documents, about, that labels are taken from; pieces collected at most; characters kept on each side of a label.
FIT_DOCUMENTS, FIT_PIECES, BESIDE = 10_000, 4_000, 40

#: Characters of a training example; of a window that is read; from one window to the next.
EXAMPLE, WINDOW, STRIDE = 72, 256, 224
OVERLAP = WINDOW - STRIDE
#: Windows that the network reads at once; characters that are decoded at once, or one text.
WINDOWS_AT_ONCE, CHARS_AT_ONCE = 512, 1 << 20
#: Characters of a piece of the path, and of those beside it that its guess is made from.
PIECE, AROUND = 512, 64
#: Turns in which all pieces whose guess failed are scored again side by side; what is left then goes in order.
ROUNDS = 3

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _ip_holds(s: str) -> bool:
    return all(int(x[-4:]) <= 255 and not x[:-4].strip("0") for x in s.split("."))


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches of the address pattern, found from their at signs in time linear in the text."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            last = found.end()
            yield start, last, "email"
        at = text.find("@", found.end() if found else at + 1)


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start and then kind."""
    out = list(_emails(text)) if "@" in text else []
    if DIGIT.search(text):
        out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if _ip_holds(m[0])]
        for m in CARD.finditer(text):
            d = _digits(m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# --- the model -----------------------------------------------------------------------------

TAGS = 1 + 2 * len(LEARNED)  # outside, and for each kind its first and its later characters
_PUNCT = " .@-_+()[]:,/%\n"


def _symbol_table() -> np.ndarray:
    table = np.full(0x180, 1, np.int8)  # 1: anything else
    for i in range(0x180):
        c = chr(i)
        if c.isdigit() and i < 128:
            table[i] = 2
        elif c in _PUNCT:
            table[i] = 3 + _PUNCT.index(c)
        elif i < 128 and c.isalpha():
            table[i] = 20 + ord(c.lower()) - 97
        elif c.isalpha():
            table[i] = 46
    return table


_TABLE = _symbol_table()
SYMBOL_COUNT = 47
#: What lies beyond the end of a text.
BEYOND = 3 + _PUNCT.index(" ")


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _TABLE[np.minimum(codes, 0x17F)]


def squash(x: np.ndarray) -> np.ndarray:
    """Into (-1, 1) like tanh, at the cost of a division; its slope is (1 - |y|)**2 where it gives y."""
    return x / (1 + np.abs(x))


@dataclass
class Model:
    """Gates and cells of the network go through ``squash``. Parameters by name: embedding E, per direction W and b, output V and c, transitions T."""

    p: dict[str, np.ndarray]
    hidden: int

    @staticmethod
    def fresh(rng: np.random.Generator, hidden: int = 12, width: int = 10) -> "Model":
        def normal(*shape: int) -> np.ndarray:
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

        p = {"E": rng.normal(0, 0.5, (SYMBOL_COUNT, width)), "V": normal(2 * hidden, TAGS), "c": np.zeros(TAGS), "T": np.zeros((TAGS, TAGS))}
        for d in "fb":
            p["W" + d], p["b" + d] = normal(width + hidden, 4 * hidden), np.zeros(4 * hidden)
            p["b" + d][hidden : 2 * hidden] = 1  # remember at first
        return Model({k: v.astype(np.float32) for k, v in p.items()}, hidden)

    def _pass(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """x: time, batch, width; hidden states in the same order, and what the way back needs."""
        n, h = x.shape[1], self.hidden
        w, b = self.p["W" + d], self.p["b" + d]
        wx = x @ w[: x.shape[2]] + b
        wh = w[x.shape[2] :]
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out, kept = np.empty((len(x), n, h), np.float32), []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = wx[t] + state @ wh
            gates = 0.5 + 0.5 * squash(z[:, : 3 * h])
            i, f, o, g = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :], squash(z[:, 3 * h :])
            before = cell
            cell = f * cell + i * g
            squashed = squash(cell)
            if keep:
                kept.append((t, state, before, i, f, o, g, squashed))
            state = o * squashed
            out[t] = state
        return out, kept

    def emissions(self, s: np.ndarray) -> np.ndarray:
        """s: batch, time of symbols; scores as batch, time, tag.

        Both directions advance together, with gates as rows, and one product a step gives all gates
        and what the states before it score. Gates (but the one that forgets), cells and states are
        held doubled, their halves in the weights: that is exact, and spares halving the gates.
        """
        n, steps, h, width = len(s), s.shape[1], self.hidden, self.p["E"].shape[1]
        half, taken = np.float32(0.5), np.zeros((2, 4 * h + TAGS, h + width + 1), np.float32)
        for k, d in enumerate("fb"):
            taken[k, : 4 * h, :h], taken[k, : 4 * h, h:-1], taken[k, : 4 * h, -1] = half * self.p["W" + d][width:].T, self.p["W" + d][:width].T, self.p["b" + d]
            taken[k, 4 * h :, :h] = half * self.p["V"][k * h : (k + 1) * h].T
        taken[0, 4 * h :, -1] = self.p["c"]
        letters, across = np.ascontiguousarray(self.p["E"].T), np.ascontiguousarray(s.T, dtype=np.intp)
        given, both = np.zeros((2, h + width + 1, n), np.float32), np.empty((2, 4 * h + TAGS, n), np.float32)
        given[:, -1] = 1
        state, z, scored = given[:, :h], both[:, : 4 * h], both[:, 4 * h :]
        cell, some, over = np.zeros((2, h, n), np.float32), np.empty((2, h, n), np.float32), np.empty((2, 4 * h, n), np.float32)
        gates, (i, f, o, g) = z[:, : 3 * h], (z[:, k * h : (k + 1) * h] for k in range(4))
        scores = np.zeros((steps, TAGS, n), np.float32)
        for t in range(steps + 1):
            if t < steps:
                np.take(letters, across[t], axis=1, out=given[0, h:-1], mode="clip")
                np.take(letters, across[steps - 1 - t], axis=1, out=given[1, h:-1], mode="clip")
            np.matmul(taken, given, out=both)
            if t:
                scores[t - 1] += scored[0]
                scores[steps - t] += scored[1]
            np.abs(z, out=over)
            over += 1
            z /= over
            gates += 1
            f *= half
            cell *= f
            cell += np.multiply(i, g, out=some)
            np.abs(cell, out=some)
            some += 2
            np.divide(cell, some, out=some)
            np.multiply(some, o, out=state)
        return scores.transpose(2, 0, 1)

    def gradient(self, s: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags ``y`` (batch, time) and its gradient."""
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        x = self.p["E"][s.T]
        runs = {d: self._pass(x, d, True) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        e = both @ self.p["V"] + self.p["c"]
        steps, n = s.shape[1], len(s)
        loss, de, g["T"] = self._crf(e, y.T)
        de /= n
        g["T"] /= n
        g["c"], g["V"] = de.sum((0, 1)), np.einsum("tnh,tnk->hk", both, de)
        dboth = de @ self.p["V"].T
        dx = np.zeros_like(x)
        width, h = x.shape[2], self.hidden
        for k, d in enumerate("fb"):
            w = self.p["W" + d]
            dstate, dcell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            for t, state, before, i, f, o, gg, squashed in reversed(runs[d][1]):
                dh = dboth[t, :, k * h : (k + 1) * h] + dstate
                dc = dh * o * (1 - np.abs(squashed)) ** 2 + dcell
                slope = lambda gate: 0.5 * (1 - np.abs(2 * gate - 1)) ** 2
                dz = np.concatenate([dc * gg * slope(i), dc * before * slope(f), dh * squashed * slope(o), dc * i * (1 - np.abs(gg)) ** 2], axis=1)
                g["W" + d][:width] += x[t].T @ dz
                g["W" + d][width:] += state.T @ dz
                g["b" + d] += dz.sum(0)
                dx[t] += dz @ w[:width].T
                dstate, dcell = dz @ w[width:].T, dc * f
        np.add.at(g["E"], s.T, dx)
        return loss / n / steps, g

    def _crf(self, e: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss of tag paths, with its gradients by emissions and transitions, by the forward-backward sums."""
        steps, n, k = e.shape
        trans = self.p["T"]

        def total(a: np.ndarray, axis: int) -> np.ndarray:
            m = a.max(axis=axis, keepdims=True)
            return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis=axis))

        ahead, behind = np.empty_like(e), np.zeros_like(e)
        ahead[0] = e[0]
        for t in range(1, steps):
            ahead[t] = e[t] + total(ahead[t - 1][:, :, None] + trans[None], 1)
        for t in range(steps - 2, -1, -1):
            behind[t] = total(trans[None] + (e[t + 1] + behind[t + 1])[:, None, :], 2)
        z = total(ahead[-1], 1)
        de = np.exp(ahead + behind - z[None, :, None])
        pair = np.exp(ahead[:-1, :, :, None] + trans + (e[1:] + behind[1:])[:, :, None, :] - z[None, :, None, None])
        dtrans = pair.sum((0, 1))
        rows = np.arange(n)
        score = sum(e[t, rows, y[t]] for t in range(steps)) + sum(trans[y[t - 1], y[t]] for t in range(1, steps))
        for t in range(steps):
            de[t, rows, y[t]] -= 1
        np.add.at(dtrans, (y[:-1].ravel(), y[1:].ravel()), -1)
        return float((z - score).sum()), de.astype(np.float32), dtrans.astype(np.float32)


def _allowed() -> np.ndarray:
    """False where a later character of a kind would not follow one of the same kind."""
    ok = np.ones((TAGS, TAGS), dtype=bool)
    for k in range(len(LEARNED)):
        inside = 2 + 2 * k
        ok[:, inside] = False
        ok[[inside, inside - 1], inside] = True
    return ok


_BARRED = -1e4
#: What rounding may do to the sums that show a character to be outside.
DOUBT = 0.1


def viterbi(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best path through emissions (time, tag) that lie between two outside characters."""
    steps, tags = e.shape
    n = steps // PIECE + 1
    step = np.where(_allowed(), trans, _BARRED).astype(np.float32)
    rows = np.full((n * PIECE, tags), _BARRED, np.float32)
    rows[:steps] = e
    rows[steps:, 0] = 0
    rows = np.ascontiguousarray(rows.reshape(n, PIECE, tags).transpose(1, 2, 0))
    first, later = slice(1, None, 2), slice(2, None, 2)
    into_outside, into_first = step[:, :1], np.ascontiguousarray(step[:, first].T)[:, :, None]
    follows = np.diag(step, 1)[first, None], np.diag(step)[later, None]

    def forward(some: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Scores after each row of ``some`` (time, tag, piece), the best of each as 0."""
        out = np.empty(some.shape, np.float32)
        for t in range(len(some)):
            now = out[t]
            (score + into_outside).max(axis=0, out=now[0])
            (score[None] + into_first).max(axis=1, out=now[first])
            np.maximum(score[first] + follows[0], score[later] + follows[1], out=now[later])
            now += some[t]
            now -= now.max(axis=0)
            score = now
        return out

    def behind(score: np.ndarray, tag: np.ndarray) -> np.ndarray:
        return (score + np.take(step, tag, axis=1, mode="clip")).argmax(axis=0)

    def backward(some: np.ndarray, tag: np.ndarray) -> np.ndarray:
        """Tags at each row of ``some`` on the best paths that end in ``tag``."""
        out = np.empty((len(some), some.shape[2]), np.int8)
        out[-1] = tag
        for t in range(len(some) - 1, 0, -1):
            out[t - 1] = tag = behind(some[t - 1], tag)
        return out

    begin = np.full((tags, n), _BARRED, np.float32)
    begin[0] = 0
    begin[:, 1:] = forward(rows[-AROUND:, :, :-1], np.zeros((tags, n - 1), np.float32))[-1]
    scores = forward(rows, begin)
    for turn in range(n):  # after a few turns the rest is scored in order, so that no piece is scored often
        ends = np.maximum(scores[-1, :, :-1], _BARRED)
        wrong = 1 + np.flatnonzero((np.abs(np.maximum(begin[:, 1:], _BARRED) - ends) > 1e-2).any(axis=0))
        if not len(wrong):
            break
        if turn == ROUNDS:
            for k in range(wrong[0], n):
                end = np.maximum(scores[-1, :, k - 1 : k], _BARRED)
                if (np.abs(np.maximum(begin[:, k : k + 1], _BARRED) - end) > 1e-2).any():
                    begin[:, k : k + 1] = end
                    scores[:, :, k : k + 1] = forward(rows[:, :, k : k + 1], end)
            break
        begin[:, wrong] = ends[:, wrong - 1]
        scores[:, :, wrong] = forward(rows[:, :, wrong], begin[:, wrong])

    last = np.zeros(n, np.int64)
    beyond = backward(scores[:AROUND, :, 1:], scores[AROUND - 1, :, 1:].argmax(axis=0))
    last[:-1] = behind(scores[-1, :, :-1], beyond[0])
    path = backward(scores, last)
    for turn in range(n):
        found = behind(scores[-1, :, :-1], path[0, 1:])
        wrong = np.flatnonzero(found != last[:-1])
        if not len(wrong):
            break
        if turn == ROUNDS:
            for k in range(wrong[-1], -1, -1):
                found = behind(scores[-1, :, k : k + 1], path[0, k + 1 : k + 2])
                if found[0] != last[k]:
                    last[k] = found[0]
                    path[:, k : k + 1] = backward(scores[:, :, k : k + 1], last[k : k + 1])
            break
        last[wrong] = found[wrong]
        path[:, wrong] = backward(scores[:, :, wrong], last[wrong])
    return path.T.ravel()[:steps].astype(np.int64)


def gains(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """At most what a character inside a span adds to a path, against one outside. e: tags along the second axis."""
    inside = np.where(_allowed(), trans, _BARRED)[1:, 1:].max(axis=0) - trans[0, 0]
    top = e[:, 1] + inside[0]
    for k in range(2, TAGS):
        np.maximum(top, e[:, k] + inside[k - 1], out=top)
    return top - e[:, 0]


def doubtful(gain: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """False where the best path is outside for sure: no run of characters there gains what its two ends may cost.

    A run of the path between two outside characters scores, against staying outside, its ``gains``
    and at most ``ends``; the best path has no run that loses. The best sum of a run over a character
    is the highest of the prefix sums from there on, less the lowest until there.
    """
    step = np.where(_allowed(), trans, _BARRED).astype(np.float64)
    ends = max(0.0, (step[0, 1:] - step[1:, 1:].max(axis=0))[::2].max()) + step[1:, 0].max() - step[0, 0]
    sums = np.concatenate(([0.0], np.cumsum(gain, dtype=np.float64)))
    highest = np.maximum.accumulate(sums[:0:-1])[::-1]
    return highest - np.minimum.accumulate(sums[:-1]) + ends >= -DOUBT


# --- labelled spans ------------------------------------------------------------------------


PIECE_SCHEMA = "before string, piece string, kind string, after string"


def labelled_pieces(text: str) -> list[tuple[str, str, str | None, str]]:
    """Labelled spans of a text with what stands beside them, and one piece of its middle without any."""
    found = base_spans(text)
    found += [(*m.span(1), "secret") for m in SECRET.finditer(text) if not any(s < m.end(1) and m.start(1) < e for s, e, _ in found)]
    out = [(text[max(0, s - BESIDE) : s], text[s:e], k, text[e : e + BESIDE]) for s, e, k in found]
    at = max(0, len(text) // 2 - EXAMPLE)
    if not any(s < at + 2 * EXAMPLE and at < e for s, e, _ in found):
        out.append((text[at : at + EXAMPLE], "", None, text[at + EXAMPLE : at + 2 * EXAMPLE]))
    return out


def labelled(docs: DataFrame, documents: int = FIT_DOCUMENTS, pieces: int = FIT_PIECES) -> list[tuple[str, str, str | None, str]]:
    """At most ``pieces`` pieces, labelled ones first, of about ``documents`` documents; both are chosen by hash, so reruns agree."""
    spread = max(docs.count(), documents)
    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(spread)) < documents).filter(F.length("text") > 0).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for t in batch.column("text").to_pylist() for r in labelled_pieces(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], [c.split()[0] for c in PIECE_SCHEMA.split(", ")])

    made = some.mapInArrow(run, PIECE_SCHEMA)
    names = ["before", "piece", "kind", "after"]
    chosen = [made.filter(kind).orderBy(F.xxhash64(*names), *names).limit(n).collect() for kind, n in ((F.col("kind").isNotNull(), pieces // 2), (F.col("kind").isNull(), pieces // 2))]
    return [tuple(r) for rows in chosen for r in rows]


#: Ways in which an at sign, a full stop, and the gaps of a number are written in training.
ATS = ("@", "(at)", "[at]", " at ", " (at) ", " [at] ", " @ ", "{at}")
DOTS = (".", "[.]", "(.)", " . ", " dot ", "(dot)", "[dot]", " (dot) ")
GAPS = ("", " ", "-", ".", "/", "_", " - ")


def redrawn(rng: np.random.Generator, kind: str, piece: str) -> str:
    """A span of the same kind with other digits, and for an address other names, fewer or more of them."""
    def word(low: int, high: int) -> str:
        return "".join(chr(97 + int(i)) for i in rng.integers(0, 26, rng.integers(low, high)))

    if kind == "email" and rng.random() < 0.6:
        name = word(2, 9) + ("", ".", "_", "-")[int(rng.integers(0, 4))] + word(1, 8) if rng.random() < 0.7 else word(3, 9) + str(int(rng.integers(0, 1000)))
        return f"{name}@{'.'.join(word(2, 10) for _ in range(int(rng.integers(1, 3))))}.{word(2, 5)}"
    return "".join(str(int(rng.integers(0, 10))) if c in "0123456789" and rng.random() < 0.5 else c for c in piece)


def disguised(rng: np.random.Generator, kind: str, piece: str) -> str:
    """A span as someone might write it around the patterns."""
    def one(ways: tuple[str, ...]) -> str:
        return ways[int(rng.integers(0, len(ways)))]

    if kind == "email":
        at, dot = one(ATS), one(DOTS)
        return piece.replace("@", "\0").replace(".", dot).replace("\0", at)
    if kind == "ip":
        return piece.replace(".", one(DOTS))
    d, gap = _digits(piece), one(GAPS)
    if kind == "card":
        return gap.join(d[i : i + 4] for i in range(0, len(d), 4))
    if kind == "phone":
        body, lead = d[-10:], d[:-10]
        inner = one(("({}) {}" + gap + "{}", "{}" + gap + "{}" + gap + "{}")).format(body[:3], body[3:6], body[6:])
        return (one(("+", "00", "")) + lead + one((" ", "-", ".")) if lead and rng.random() < 0.5 else "") + inner
    return piece


def examples(rng: np.random.Generator, pieces: list[tuple[str, str, str | None, str]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """n windows drawn from labelled pieces, kinds alike often: symbols and tags."""
    by_kind: dict[str | None, list] = {}
    for r in pieces:
        by_kind.setdefault(r[2], []).append(r)
    kinds = [k for k in LEARNED if k in by_kind]
    xs, ys = np.zeros((n, EXAMPLE), np.int64), np.zeros((n, EXAMPLE), np.int64)
    for r in range(n):
        text, tags = "", []
        while len(text) < 2 * EXAMPLE:
            kind = None if None in by_kind and rng.random() < 0.3 else kinds[int(rng.integers(0, len(kinds)))]
            before, piece, _, after = by_kind[kind][int(rng.integers(0, len(by_kind[kind])))]
            if kind:
                piece = redrawn(rng, kind, piece)
                piece = disguised(rng, kind, piece) if rng.random() < 0.6 else piece
                before = before[int(rng.integers(0, len(before) + 1)) :]
            first = 1 + 2 * LEARNED.index(kind) if kind else 0
            text += before + piece + after
            tags += [0] * len(before) + ([first] + [first + 1] * (len(piece) - 1) if piece else []) + [0] * len(after)
            gap = (" ", "\n", ". ")[int(rng.integers(0, 3))]
            text, tags = text + gap, tags + [0] * len(gap)
        # a window that cuts a span begins inside it
        at = int(rng.integers(0, EXAMPLE))
        xs[r], ys[r] = symbols(text)[at : at + EXAMPLE], tags[at : at + EXAMPLE]
    return xs, ys


def trained(pieces: list[tuple[str, str, str | None, str]], seed: int = 11, steps: int = 600, batch: int = 48) -> Model | None:
    """The model after ``steps`` of Adam over examples of ``pieces``; the same for the same arguments. None where no piece is labelled."""
    if not any(r[2] for r in pieces):
        return None
    rng = np.random.default_rng(seed)
    model, rate = Model.fresh(rng), 0.02
    pool = examples(rng, pieces, 50 * batch)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(x) for k, x in model.p.items()}
    for i in range(1, steps + 1):
        pick = rng.integers(0, len(pool[0]), batch)
        _, g = model.gradient(pool[0][pick], pool[1][pick])
        norm = np.sqrt(sum(float((x**2).sum()) for x in g.values()))
        pace = rate * (1 - 0.9 * i / steps)
        for k in model.p:
            d = g[k] * min(1.0, 5.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.99 * v[k] + 0.01 * d * d
            model.p[k] -= (pace * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
    return model


# --- whole texts ---------------------------------------------------------------------------

_CENTRE = (1 + np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])).astype(np.float32)


def holds(kind: str, piece: str) -> bool:
    """Whether a decoded span has a value of its kind, however it is written."""
    d, parts = _digits(piece), re.findall(r"[A-Za-z0-9]+", piece)
    if kind == "card":
        return 12 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(d) <= 15
    if kind == "ip":
        numbers = re.findall(r"[0-9]+", piece)
        return len(numbers) == 4 and all(_ip_holds(x) for x in numbers)
    if kind == "secret":
        return len(d) > 0 and any(len(x) >= 16 for x in re.findall(r"[A-Za-z0-9_+/=-]+", piece))
    return len(parts) >= 3 and re.fullmatch(r"[A-Za-z]{2,}", parts[-1]) is not None and ("@" in piece or "at" in [x.lower() for x in parts[1:-2]])


def _windows(text: str) -> np.ndarray:
    """The symbols of each window of a text that is not empty."""
    count = 1 + max(0, -(-(len(text) - WINDOW) // STRIDE))
    padded = np.full((count - 1) * STRIDE + WINDOW, BEYOND, np.int8)
    padded[: len(text)] = symbols(text)
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


class _Layout:
    """Windows of texts put on rows of STRIDE characters, where each text has one row more than windows."""

    def __init__(self, counts: list[int]):
        texts = np.arange(len(counts))
        self.first = np.concatenate(([0], np.cumsum(np.array(counts) + 1)))  # rows where texts begin
        self.of_row = np.repeat(texts, np.array(counts) + 1)
        self.row = np.arange(sum(counts)) + np.repeat(texts, counts)  # of each window
        self.begun, self.over = np.ones(len(self.of_row), bool), np.ones(len(self.of_row), bool)
        self.begun[self.first[1:] - 1] = False  # rows where no window begins
        self.over[self.first[:-1]] = False  # rows where no window ends

    def averaged(self, values: np.ndarray) -> np.ndarray:
        """Values of characters, by rows, from those of their windows."""
        values = values * _CENTRE
        out = np.zeros((len(self.of_row), STRIDE), np.float32)
        out[self.row] = values[:, :STRIDE]
        out[self.row + 1, :OVERLAP] += values[:, STRIDE:]
        weight = np.tile(_CENTRE[:STRIDE], (len(out), 1))
        weight[:, :OVERLAP] = self.begun[:, None] * _CENTRE[:OVERLAP] + self.over[:, None] * _CENTRE[STRIDE:]
        return out / weight

    def picked(self, scores: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        """Emissions of the characters ``at``, which ascend, from scores of windows, which are in blocks of WINDOWS_AT_ONCE."""
        row, offset = np.divmod(at, STRIDE)
        window = row - self.of_row[row]
        out, weight = np.zeros((len(at), TAGS), np.float32), np.zeros((len(at), 1), np.float32)
        for w, r, has in ((window, offset, self.begun[row]), (window - 1, offset + STRIDE, self.over[row] & (offset < OVERLAP))):
            has = np.flatnonzero(has)  # in order, so those of a block are side by side
            blocks = np.searchsorted(w[has], np.arange(len(scores) + 1) * WINDOWS_AT_ONCE)
            for k, block in enumerate(scores):
                own = has[blocks[k] : blocks[k + 1]]
                out[own] += block[w[own] - k * WINDOWS_AT_ONCE, r[own]] * _CENTRE[r[own], None]
                weight[own, 0] += _CENTRE[r[own]]
        out /= weight
        return out


def _groups(texts: list[str]) -> Iterator[list[int]]:
    """Texts that are not empty, in order, in groups of CHARS_AT_ONCE characters or one text."""
    some, held = [], 0
    for i, text in enumerate(texts):
        if some and held + len(text) > CHARS_AT_ONCE:
            yield some
            some, held = [], 0
        if text:
            some.append(i)
            held += len(text)
    if some:
        yield some


def model_spans(model: Model, texts: list[str]) -> list[list[Span]]:
    """Per text the spans on the best path that hold as their kind; every character is read."""
    out: list[list[Span]] = [[] for _ in texts]
    trans = model.p["T"]
    for group in _groups(texts):
        windows = [_windows(texts[i]) for i in group]
        layout, rows = _Layout([len(w) for w in windows]), np.concatenate(windows)
        scores = [model.emissions(rows[k : k + WINDOWS_AT_ONCE]) for k in range(0, len(rows), WINDOWS_AT_ONCE)]
        # an average gains at most the average of what its parts gain
        gain = layout.averaged(np.concatenate([gains(s.transpose(1, 2, 0), trans).T for s in scores])).ravel()
        begins = layout.first * STRIDE
        within = np.zeros(len(gain), bool)
        for k, i in enumerate(group):
            within[begins[k] : begins[k] + len(texts[i])] = True
        gain[~within] = _BARRED
        at = np.flatnonzero(doubtful(gain, trans) & within)
        if not len(at):
            continue
        # runs in doubt, each with a place outside after it
        place = np.arange(len(at)) + np.cumsum(np.diff(at, prepend=at[:1]) > 1)
        picked = layout.picked(scores, at)
        del scores  # where all is in doubt, each of these is as large as the other
        e = np.full((place[-1] + 2, TAGS), _BARRED, np.float32)
        e[:, 0] = 0
        e[place] = picked
        del picked
        path = viterbi(e, trans)
        over = np.flatnonzero((path == 0) | (path % 2 == 1))  # where a span that began earlier is over
        for t in np.flatnonzero(path % 2 == 1):
            where = at[np.searchsorted(place, t)]
            k = int(layout.of_row[where // STRIDE])
            i, start = group[k], int(where - begins[k])
            end, kind = start + int(over[np.searchsorted(over, t, "right")] - t), LEARNED[path[t] // 2]
            if holds(kind, texts[i][start:end]):
                out[i].append((start, end, kind))
    return out


def all_spans(model: Model | None, texts: list[str]) -> list[tuple[list[Span], list[Span], list[Span]]]:
    """Per text its base spans, those with what the model adds, and secrets."""
    found = []
    for base, more in zip([base_spans(t) for t in texts], model_spans(model, texts) if model else [[] for _ in texts]):
        covered = np.zeros(max((e for _, e, _ in base + more), default=0), dtype=bool)
        for s, e, _ in base:
            covered[s:e] = True
        added = [x for x in more if x[2] in KINDS and not covered[x[0] : x[1]].any()]
        found.append((base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2]))), [x for x in more if x[2] not in KINDS]))
    return found


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, secrets string, n_found long"


def _finder(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                found = all_spans(model, [t or "" for t in part.column("text").to_pylist()])
                counts = [pa.array([sum(s[2] == k for s in base) for base, _, _ in found], pa.int64()) for k in KINDS]
                sha = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _, _ in found], pa.string())
                spans, secrets = (pa.array([written(f[k]) for f in found], pa.string()) for k in (1, 2))
                added, every = pa.array([len(f[1]) - len(f[0]) for f in found], pa.int64()), pa.array([len(f[1]) + len(f[2]) for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, sha, spans, added, secrets, every], [c.split()[0] for c in SCHEMA.split(", ")])

    return run


def find_personal_data(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, counts and digest of the base spans, all spans, how many were added, secrets, and how many spans of any kind.

    Without a ``model`` one is trained from ``docs``.
    """
    return docs.select("doc_id", "text").mapInArrow(_finder(model or trained(labelled(docs))), SCHEMA)


def redacted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` (doc_id, text) with every span and secret replaced by its kind in angle brackets."""
    model = model or trained(labelled(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i in range(0, len(texts), 256):
                some, out = texts[i : i + 256], []
                for text, (_, spans, secrets) in zip(some, all_spans(model, [t or "" for t in some])):
                    made, last = [], 0
                    for s, e, k in sorted(spans + secrets):
                        if s >= last:
                            made += [text[last:s], f"<{k}>"]
                        last = max(last, e)
                    out.append(None if text is None else "".join(made) + text[last:])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 256), pa.array(out, pa.string())], ["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id", "text").schema)


def document_spans(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row for each span and secret: doc_id, kind, start, end."""
    both = F.array_remove(F.concat(F.split("spans", ","), F.split("secrets", ",")), "")
    found = find_personal_data(docs, model).select("doc_id", F.explode(both).alias("s"))
    part = F.split("s", ":")
    return found.select("doc_id", part[0].alias("kind"), part[1].cast("long").alias("start"), part[2].cast("long").alias("end"))
