"""Personal data: exact rules, and a character-level bidirectional LSTM with CRF transitions.

The rules' spans, and the same spans rewritten in forms that no rule has (spaced,
split, spelt out), label the training windows. The model, trained in numpy on a
bounded sample of them, reads overlapping windows of every whole text around all
that an added span has to contain (a digit, an ``@`` or the word ``at`` before a
dot, as ``fits`` asks); windows' tag scores are averaged where they overlap, and
one best path is decoded over them. It adds that path's spans that fit their kind.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sparkutil import columns, named, output, session, whole_rows

KINDS = ("email", "ip", "card", "phone")
#: Training windows with the rules' spans, with rewritten ones, and without any at most (those with the smallest
#: hashes), their length, and passes.
WITH, VARIED, WITHOUT, TRAIN_LENGTH, EPOCHS = 1_200, 2_400, 1_600, 80, 4
#: Characters of a window, its step, and what is read on either side of a digit, an @ or an at.
WINDOW, STEP, MARGIN = 128, 96, 48
HIDDEN, RATE, SIZE = 16, 0.02, 48
#: Windows read together, characters whose scores are held at a time, and the overlap of such sections.
TOGETHER, SECTION, OVERLAP = 512, 400_000, 4_096
#: Forms in which training has each span, besides its own.
REWRITES = 3
#: Characters of an address in any form at most.
LONGEST = 254

# The rules' patterns. They are possessive and begin where their first run begins, so that a run is read
# once, however long; a match that begins where the one before ended is looked for by itself.
_EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
_EMAIL_HERE = re.compile(_EMAIL)
RULES = (
    re.compile(r"(?<![A-Za-z0-9._%+-])" + _EMAIL),
    re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    re.compile(r"[0-9](?:[\x20-]?[0-9])++"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)
_TRIGGER = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[0-9]")
_AT = re.compile(r"(?<![A-Za-z])at(?![A-Za-z])", re.I)
_DOT = re.compile(r"(?<![A-Za-z])dot(?![A-Za-z])|\.[A-Za-z0-9]", re.I)
_NUMBERS = re.compile(r"[0-9]+")
_LETTERS = re.compile(r"[A-Za-z0-9]+")

#: Forms in which training rewrites the rules' spans, by kind: what stands for the signs between their parts.
FORMS = (
    ((" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), (" @ ", " . "), ("(@)", "."), (" [at] ", ".")),
    (" . ", "[.]", " dot ", ". ", "(.)"),
    (".", "/", "_", "  ", " - ", "--"),
    (".", "/", " ", "-", " - ", ") "),
)

TAGS = 1 + 2 * len(KINDS)
#: Codes of characters: 0 for none, then ASCII, other Latin letters, and all others.
CODES, _LATIN, _OTHER = 131, 129, 130
_CODE = np.full(0x251, _OTHER, np.uint8)
_CODE[:0x80] = np.arange(1, 0x81)
_CODE[0xC0:0x250] = _LATIN
_CODE[0xA0] = 1 + ord(" ")
#: Codes that start out alike: digits, capitals, small letters.
_ALIKE = np.arange(CODES)
for _first, _last in ("09", "AZ", "az"):
    _ALIKE[1 + ord(_first) : 2 + ord(_last)] = 1 + ord(_first)
_ALIKE[_LATIN] = 1 + ord("a")


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _holds(kind: int, text: str) -> bool:
    """Whether a match of a rule has the right numbers."""
    if kind == 0:
        return True
    if kind == 1:
        return all(len(p) <= 3 and int(p or "0") <= 255 for p in (part.lstrip("0") for part in text.split(".")))
    digits = "".join(_DIGITS.findall(text))
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, end, kind)`` of the rules' matches that hold, by start and kind."""
    if not _TRIGGER.search(text):
        return []
    found = [(m.start(), m.end(), k) for k, rule in enumerate(RULES) if k for m in rule.finditer(text) if _holds(k, m.group())]
    at = 0 if "@" in text else -1
    while at >= 0:
        m = at and _EMAIL_HERE.match(text, at) or RULES[0].search(text, at)
        if m:
            found.append((m.start(), m.end(), 0))
        at = m.end() if m else -1
    return sorted(found, key=lambda s: (s[0], s[2]))


def codes(text: str) -> np.ndarray:
    """Codes of a text's characters, from 1."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _CODE[np.minimum(points, 0x250)]


def rewritten(text: str, kind: int, form: int) -> str:
    """A span in another form: the signs between its parts are replaced."""
    signs = FORMS[kind][form % len(FORMS[kind])]
    if kind == 0:
        name, domain = text.split("@")
        return name + signs[0] + domain.replace(".", signs[1])
    if kind == 2:
        digits = "".join(_DIGITS.findall(text))
        return signs.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    parts = _NUMBERS.findall(text)
    return ("(" if signs == ") " else "") + signs.join(parts)


def _tags(n: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    tags = np.zeros(n, np.uint8)
    for start, end, kind in spans:
        if not tags[start:end].any():
            tags[start:end] = 2 + 2 * kind
            tags[start] = 1 + 2 * kind
    return tags


# --- the model -----------------------------------------------------------------

_FORBIDDEN = np.zeros((TAGS, TAGS), bool)
for _k in range(len(KINDS)):
    _FORBIDDEN[:, 2 + 2 * _k] = True
    _FORBIDDEN[[1 + 2 * _k, 2 + 2 * _k], 2 + 2 * _k] = False
_NO = np.float32(-1e4)

Params = dict[str, np.ndarray]


def initial() -> Params:
    rng = np.random.default_rng(17)
    p = {}
    for side in "fb":
        p[f"x{side}"] = rng.normal(0, 0.3, (CODES, 4 * HIDDEN))[_ALIKE] + rng.normal(0, 0.05, (CODES, 4 * HIDDEN))
        p[f"h{side}"] = rng.normal(0, 0.3, (HIDDEN, 4 * HIDDEN))
        p[f"x{side}"][:, HIDDEN : 2 * HIDDEN] += 1
    p["e"], p["c"], p["t"] = rng.normal(0, 0.3, (2 * HIDDEN, TAGS)), np.zeros(TAGS), np.zeros((TAGS, TAGS))
    return {k: v.astype(np.float32) for k, v in p.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, keep: bool):
    """States of a sequence batch ``x`` (time, batch); gates too if asked for."""
    n, size = x.shape
    h, c = np.zeros((size, HIDDEN), np.float32), np.zeros((size, HIDDEN), np.float32)
    out, saved = np.empty((n, size, HIDDEN), np.float32), []
    for t in range(n):
        a = wx[x[t]]
        a += h @ wh
        s = _sigmoid(a[:, : 3 * HIDDEN])
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        g = np.tanh(a[:, 3 * HIDDEN :])
        before, c = c, f * c + i * g
        tc = np.tanh(c)
        if keep:
            saved.append((h, before, i, f, o, g, tc))
        h = o * tc
        out[t] = h
    return out, saved


def _lstm_back(x, wx, wh, saved, grad):
    """Gradients of the input table and the recurrent matrix."""
    gx, gh = np.zeros_like(wx), np.zeros_like(wh)
    dh, dc = np.zeros_like(grad[0]), np.zeros_like(grad[0])
    for t in range(len(x) - 1, -1, -1):
        h, before, i, f, o, g, tc = saved[t]
        dh = dh + grad[t]
        dc = dc + dh * o * (1 - tc * tc)
        a = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
        np.add.at(gx, x[t], a)
        gh += h.T @ a
        dh, dc = a @ wh.T, dc * f
    return gx, gh


def emissions(p: Params, x: np.ndarray) -> np.ndarray:
    """Tag scores (time, batch, tag) of class codes (time, batch)."""
    forward, _ = _lstm(x, p["xf"], p["hf"], False)
    backward, _ = _lstm(x[::-1], p["xb"], p["hb"], False)
    return np.concatenate([forward, backward[::-1]], 2) @ p["e"] + p["c"]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def gradients(p: Params, x: np.ndarray, y: np.ndarray) -> tuple[float, Params]:
    """Mean negative log-likelihood of the tag paths ``y`` and its gradients."""
    forward, saved_f = _lstm(x, p["xf"], p["hf"], True)
    backward, saved_b = _lstm(x[::-1], p["xb"], p["hb"], True)
    states = np.concatenate([forward, backward[::-1]], 2)
    e = states @ p["e"] + p["c"]
    trans = np.where(_FORBIDDEN, _NO, p["t"])
    n, size, _ = e.shape
    rows = np.arange(size)
    first = np.where(_FORBIDDEN[0], _NO, 0)
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0] + first
    for t in range(1, n):
        alpha[t] = _logsum(alpha[t - 1][:, :, None] + trans, 1) + e[t]
    for t in range(n - 2, -1, -1):
        beta[t] = _logsum(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    z = _logsum(alpha[-1], 1)
    de = np.exp(alpha + beta - z[None, :, None])
    dt = np.zeros_like(p["t"])
    score = first[y[0]] + e[0, rows, y[0]]
    for t in range(1, n):
        dt += np.exp(alpha[t - 1][:, :, None] + trans + (e[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
        np.add.at(dt, (y[t - 1], y[t]), -1)
        score = score + trans[y[t - 1], y[t]] + e[t, rows, y[t]]
    loss = float((z - score).mean())
    np.put_along_axis(de, y[:, :, None], np.take_along_axis(de, y[:, :, None], 2) - 1, 2)
    de, dt = de / size, dt / size
    ds = de @ p["e"].T
    g: Params = {"e": np.einsum("tbs,tbk->sk", states, de), "c": de.sum((0, 1)), "t": np.where(_FORBIDDEN, 0, dt)}
    g["xf"], g["hf"] = _lstm_back(x, p["xf"], p["hf"], saved_f, ds[:, :, :HIDDEN])
    g["xb"], g["hb"] = _lstm_back(x[::-1], p["xb"], p["hb"], saved_b, ds[::-1, :, HIDDEN:])
    return loss, g


def fit(windows: np.ndarray, tags: np.ndarray) -> Params:
    """Train on class codes and tags (window, time) with Adam; the order is fixed."""
    p, rng = initial(), np.random.default_rng(5)
    m, v = ({k: np.zeros_like(w) for k, w in p.items()} for _ in range(2))
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), SIZE):
            pick = order[at : at + SIZE]
            _, g = gradients(p, windows[pick].T.astype(np.int64), tags[pick].T.astype(np.int64))
            step += 1
            rate = RATE / (1 + epoch)
            for k in p:
                gk = np.clip(g[k], -1, 1)
                m[k] += 0.1 * (gk - m[k])
                v[k] += 0.01 * (gk * gk - v[k])
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return p


def viterbi(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best tag paths (time, batch) of scores (time, batch, tag); before and after a path there is no span."""
    n, size, _ = e.shape
    back = np.empty(e.shape, np.int8)
    score = e[0] + trans[0]
    for t in range(1, n):
        options = score[:, :, None] + trans
        back[t] = options.argmax(1)
        score = options.max(1) + e[t]
    path = np.empty((n, size), np.int8)
    path[-1] = (score + trans[:, 0]).argmax(1)
    for t in range(n - 1, 0, -1):
        path[t - 1] = np.take_along_axis(back[t], path[t][:, None].astype(np.int64), 1)[:, 0]
    return path


# --- whole texts -----------------------------------------------------------------


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches around what an added span has to contain, with the margin on either side."""
    found = [m.start() for m in _TRIGGER.finditer(text)]
    found += [m.start() for m in _AT.finditer(text) if _DOT.search(text, m.end(), m.end() + LONGEST)]
    out: list[list[int]] = []
    for at in sorted(found):
        low, high = max(0, at - MARGIN), min(len(text), at + 1 + MARGIN)
        if out and low <= out[-1][1]:
            out[-1][1] = high
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def scores(p: Params, sections: list[np.ndarray]) -> list[np.ndarray]:
    """Tag scores (time, tag) of each section's codes: means over the overlapping windows that hold a character."""
    out = [np.zeros((len(c), TAGS), np.float32) for c in sections]
    times = [np.zeros((len(c), 1), np.float32) for c in sections]
    at = [(k, start) for k, c in enumerate(sections) for start in range(0, max(1, len(c) - WINDOW + STEP), STEP)]
    at.sort(key=lambda w: min(WINDOW, len(sections[w[0]]) - w[1]))  # windows of like length together
    for first in range(0, len(at), TOGETHER):
        part = at[first : first + TOGETHER]
        held = [sections[k][start : start + WINDOW] for k, start in part]
        x = np.zeros((max(map(len, held)), len(part)), np.int64)
        for i, c in enumerate(held):
            x[: len(c), i] = c
        e = emissions(p, x)
        for i, (k, start) in enumerate(part):
            n = len(held[i])
            out[k][start : start + n] += e[:n, i]
            times[k][start : start + n] += 1
    return [e / t for e, t in zip(out, times, strict=True)]


def stretches(e: np.ndarray, trans: np.ndarray) -> list[tuple[int, int]]:
    """Where the best path of scores ``e`` may have a span: elsewhere no span can gain on none.

    A span gains at most its best scores over no span's, and the best transition
    at each place and at its end; a place counts if an interval around it gains.
    """
    if not len(e):
        return []
    allowed = np.where(_FORBIDDEN, -np.inf, trans) - trans[0, 0]
    allowed[0, 0] = -np.inf
    most = float(allowed.max())
    total = np.concatenate([[0.0], np.cumsum((e[:, 1:].max(1) - e[:, 0]).astype(float) + most)])
    best = np.maximum.accumulate(total[:0:-1])[::-1] - np.minimum.accumulate(total)[:-1]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], best > -max(most, 0.0), [False]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def paths(p: Params, found: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Spans ``(start, end, kind)`` of the best path of each section's scores."""
    trans = np.where(_FORBIDDEN, _NO, p["t"])
    todo = sorted(((b - a, k, a, b) for k, e in enumerate(found) for a, b in stretches(e, trans)))
    spans: list[list[tuple[int, int, int]]] = [[] for _ in found]
    for first in range(0, len(todo), TOGETHER):
        part = todo[first : first + TOGETHER]
        e = np.full((part[-1][0], len(part), TAGS), _NO, np.float32)
        e[:, :, 0] = 0
        for i, (n, k, a, b) in enumerate(part):
            e[:n, i] = found[k][a:b]
        path = viterbi(e, trans)
        for i, (n, k, a, _) in enumerate(part):
            tags = path[:n, i]
            for start in np.flatnonzero(tags % 2 == 1).tolist():
                end = start + 1
                while end < n and tags[end] == tags[start] + 1:
                    end += 1
                spans[k].append((a + start, a + end, int(tags[start] - 1) // 2))
    return spans


def fits(text: str, kind: int) -> bool:
    """Whether the content of an added span is that of its kind, whatever its form."""
    digits = "".join(_DIGITS.findall(text))
    if kind == 0:
        m = re.search("@", text) or _AT.search(text)
        return len(text) <= LONGEST and len(_LETTERS.findall(text)) >= 3 and m is not None and bool(_DOT.search(text, m.end()) or " . " in text[m.end() :])
    if kind == 1:
        numbers = [x.lstrip("0") for x in _NUMBERS.findall(text)]
        return len(numbers) == 4 and all(len(x) <= 3 and int(x or "0") <= 255 for x in numbers)
    if any(c.isalpha() for c in text):
        return False
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and digits != text


def added_spans(text: str, spans: list[tuple[int, int, int]], taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The model's spans, less white space at their ends, that fit their kind and touch no other span."""
    kept = []
    for start, end, kind in spans:
        form = text[start:end]
        start, end = start + len(form) - len(form.lstrip()), end - (len(form) - len(form.rstrip()))
        if start < end and fits(text[start:end], kind) and not any(start < e and s < end for s, e, _ in taken):
            kept.append((start, end, kind))
    return kept


def find_spans(texts: list[str], p: Params | None) -> list[tuple[list, list]]:
    """The rules' spans and all spans of each text; windows of all texts are read together.

    A stretch of more than SECTION characters is read in sections, which overlap
    so far that each span lies whole in one: the one where it begins before the
    middle of the overlap.
    """
    base = [rule_spans(t) for t in texts]
    if p is None:
        return [(b, b) for b in base]
    model: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    waiting: list[tuple[int, int, int, int, int]] = []

    def flush() -> None:
        made = paths(p, scores(p, [codes(texts[row][low:high]) for row, low, high, *_ in waiting]))
        for (row, low, high, first, last), spans in zip(waiting, made, strict=True):
            model[row] += [(a + low, b + low, k) for a, b, k in spans if first <= a + low < last]
        waiting.clear()

    held = 0
    for row, text in enumerate(texts):
        for begin, end in regions(text):
            for low in range(begin, max(begin + 1, end - OVERLAP), SECTION - OVERLAP):
                high = min(end, low + SECTION)
                waiting.append((row, low, high, low + (OVERLAP // 2 if low > begin else 0), high - (OVERLAP // 2 if high < end else 0)))
                held += high - low
                if held >= SECTION:
                    flush()
                    held = 0
    if waiting:
        flush()
    return [(b, sorted(b + added_spans(t, sorted(g), b), key=lambda s: (s[0], s[2]))) for t, b, g in zip(texts, base, model, strict=True)]


# --- Spark jobs ----------------------------------------------------------------


def examples(text: str) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Training windows: codes, tags, and 1 if they hold the rules' spans, 2 a rewritten one, 0 none."""
    spans = rule_spans(text)
    tags = _tags(len(text), spans)
    for low, high in regions(text):
        code = codes(text[low:high])
        for at in range(low, high, TRAIN_LENGTH):
            x, y = code[at - low : at - low + TRAIN_LENGTH], tags[at : min(at + TRAIN_LENGTH, high)]
            if len(y) and y[0] and y[0] % 2 == 0:
                y = y.copy()  # a span that began before the window
                y[: int(np.argmax(np.append(y != y[0], True)))] = 0
            yield x, y, int(y.any())
    for start, end, kind, turn in ((*s, turn) for s in spans for turn in range(REWRITES)):
        seed = zlib.crc32(text[start:end].encode()) + turn
        made = rewritten(text[start:end], kind, seed)
        if kind == 1 and len(_NUMBERS.findall(made)) != 4 or len(made) > TRAIN_LENGTH - 8 or tags[start] != 1 + 2 * kind:
            continue
        before = min(start, (seed >> 8) % (TRAIN_LENGTH - 4 - len(made)) + 2)
        window = (text[start - before : start] + made + text[end : end + TRAIN_LENGTH])[:TRAIN_LENGTH]
        y = np.zeros(len(window), np.uint8)
        y[before : before + len(made)] = 2 + 2 * kind
        y[before] = 1 + 2 * kind
        near = rule_spans(window)
        if all(before <= a and b <= before + len(made) for a, b, _ in near):
            yield codes(window), y, 2
    if text:  # prose without any
        at = zlib.crc32(text[:64].encode("utf-8", "replace")) % len(text)
        y = tags[at : at + TRAIN_LENGTH]
        if not y.any():
            yield codes(text[at : at + TRAIN_LENGTH]), y, 0


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("x", pa.binary()), ("y", pa.binary()), ("has", pa.int32())])
    for batch in batches:
        found = [e for text in batch.column(0).to_pylist() if text for e in examples(text)]
        yield output(schema, x=[np.pad(x, (0, TRAIN_LENGTH - len(x))).tobytes() for x, _, _ in found], y=[np.pad(y, (0, TRAIN_LENGTH - len(y))).tobytes() for _, y, _ in found], has=[k for _, _, k in found])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    x, y = [], []
    for batch in batches:
        x += batch.column(0).to_pylist()
        y += batch.column(1).to_pylist()
    if x:
        shape = (len(x), TRAIN_LENGTH)
        found = fit(np.frombuffer(b"".join(x), np.uint8).reshape(shape), np.frombuffer(b"".join(y), np.uint8).reshape(shape))
        sink = io.BytesIO()
        np.savez(sink, **found)
        yield pa.RecordBatch.from_pydict({"model": pa.array([sink.getvalue()], pa.binary())})


def train(docs: DataFrame, text_col: str = "text") -> Params | None:
    """A model learnt from the rules' spans; None if no text has a window with one.

    All texts offer windows; at most WITH, VARIED and WITHOUT of them, distinct and with
    the smallest hashes, are fitted in one task, in the order of the hashes.
    """
    session(docs)
    windows = docs.select(F.col(text_col).alias("__text")).where("__text is not null").mapInArrow(_label, "x binary, y binary, has int").distinct()
    order = F.xxhash64("x", "y")
    none, some, varied = (windows.where(F.col("has") == k).orderBy(order, "x", "y").limit(n) for k, n in enumerate((WITHOUT, WITH, VARIED)))
    picked = some.unionByName(varied).unionByName(none)
    rows = picked.repartition(1).sortWithinPartitions(order, "x", "y").select("x", "y").mapInArrow(_fit, "model binary").collect()
    if not rows:
        return None
    with np.load(io.BytesIO(rows[0].model)) as file:
        return {k: file[k] for k in file.files}


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def find(docs: DataFrame, model: Params | None, id_col: str = "doc_id", text_col: str = "text", rows: bool = False) -> DataFrame:
    """Personal data in every whole text.

    Returns the id, the rules' counts ``n_email, n_ip, n_card, n_phone`` (long),
    ``base_sha256`` of the rules' spans, ``spans`` (``kind:start:end`` of all
    spans in code points, end exclusive, by start and kind, joined by commas) and
    ``redacted``, the text with each stretch of overlapping spans replaced by
    its first kind in brackets (null for a null text). A null text has no spans.
    Repeated rows each get a row, null ids are kept, other columns are ignored;
    with ``rows`` the whole input row comes along as the struct ``row``.
    """
    spark = session(docs)
    shared = spark.sparkContext.broadcast(model)
    source, extra = whole_rows(docs, id_col, text_col, rows)
    counts = [f"n_{k}" for k in KINDS]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([batch.schema.field(0), *((c, pa.int64()) for c in counts), ("base_sha256", pa.string()), ("spans", pa.string()), ("redacted", pa.string()), *list(batch.schema)[2:]])
            texts = batch.column(1).to_pylist()
            found = find_spans([t or "" for t in texts], shared.value)
            made = {c: [sum(s[2] == k for s in b) for b, _ in found] for k, c in enumerate(counts)}
            hidden = [t if not s else redact(t, s) for t, (_, s) in zip(texts, found, strict=True)]
            yield output(schema, **columns(batch, 0, len(texts)), **made, base_sha256=[hashlib.sha256(spell(b).encode()).hexdigest() for b, _ in found], spans=[spell(s) for _, s in found], redacted=hidden)

    fields = ", ".join(f"{c} long" for c in counts)
    return source.mapInArrow(scan, named(source, f"{fields}, base_sha256 string, spans string, redacted string", extra)).withColumnRenamed("__id", id_col)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each stretch of overlapping spans replaced."""
    parts, at = [], 0
    merged: list[list[int]] = []
    for start, end, kind in spans:
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end, kind])
    for start, end, kind in merged:
        parts += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = end
    return "".join(parts) + text[at:]
