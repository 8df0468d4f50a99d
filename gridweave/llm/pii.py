r"""Personal data: fixed patterns, and a BiLSTM-CRF tagger for forms that the patterns don't know.

The tagger is trained here on labelled spans: synthetic text in four languages around addresses, numbers
and secrets in the forms that the patterns miss as well as those they find, among decoys, from a fixed seed.

Texts are read in overlapping windows of WINDOW characters, one at every half window that holds, or whose neighbour
holds, a sign of personal data: a digit, an at sign, "(at)", "[at]" or "=". Windows in a row make a stretch; each place of
it takes its scores from the window in whose middle half it lies, and one CRF decoding of the whole stretch
reconciles them, so a span has no greatest length.

A decoded span counts if its certainty, the least probability that the CRF gives any of its tags, reaches its kind's
threshold, which is learned on other synthetic text (the least with a precision of PRECISION there). It must have
LEAST_CHARS characters and a digit or an at sign, and a card's digits must pass Luhn's check, which no tagger of
characters can learn. Tagged spans that overlap a pattern's span are dropped, as the pattern's stays.

Nulls and odd inputs: a null text is an empty text without spans. A null doc_id is passed through,
repeated rows are each scanned, other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bilstm_crf import KINDS, TAGS, Tagger, spans_of, symbols_of
from .common import doc_view, map_batches, texts_of

#: Kinds that the fixed patterns find; the tagger adds spans of these and of secrets.
BASE = KINDS[:4]

WINDOW = 128

#: Windows decoded together.
TOGETHER = 256

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGN = re.compile("[0-9@]")
_HELD = re.compile(r"[0-9@]|\(at\)|\[at\]")
_TRIGGER = re.compile(r"[0-9@=]|\(at\)|\[at\]")

#: Characters of an added span at least, and the precision at which a kind's threshold is set.
LEAST_CHARS, PRECISION = 7, 0.96


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns, by kind as listed, then start; in time linear in the text."""
    out: list[tuple[str, int, int]] = []
    end, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append(("email", begin, end))
        at = text.find("@", max(at + 1, end))
    if not _SIGN.search(text):
        return out
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        begin = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(map(_small, four)):
                out.append(("ip", begin, begin + size))
            begin += size + 1
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


# --- labelled spans ----------------------------------------------------------------------------


def _digits(r, n: int) -> str:
    return "".join(map(str, r.integers(0, 10, n)))


_SYLLABLES = {
    "en": "an er th on ing ou re st ha nd is it ti the ly ed tion wh ea or be at in es of to",
    "fr": "en le que re ou ie tre ment çe eau oi é è ê aux les de la un pa vi an eur ai",
    "de": "sch en er ich ein un der ge keit heit ung ach be st ver tz au ä ö ü ß ist lich",
    "es": "os ci ón ll la de que el an ar ió mi ñ es ta do á é í ó ente dad con por una",
}
_LANGS = {k: v.split() for k, v in _SYLLABLES.items()}


def _word(r, lang: str) -> str:
    parts = _LANGS[lang]
    if r.random() < 0.3:  # of letters alone, a vowel after each consonant
        return "".join("bcdfghklmnprstvwyz"[a] + "aeiou"[b] for a, b in zip(r.integers(18, size=4), r.integers(5, size=int(r.integers(1, 5))), strict=False))
    return "".join(parts[k] for k in r.integers(len(parts), size=int(r.integers(1, 6))))


def _plain(r) -> str:
    """A name of ASCII letters."""
    return "".join(chr(97 + c) for c in r.integers(0, 26, int(r.integers(2, 9))))


def _with_luhn(r, n: int) -> str:
    head = _digits(r, n - 1)
    return next(head + str(d) for d in range(10) if luhn(head + str(d)))


def _grouped(digits: str, sizes: list[int], gap: str) -> str:
    out, at = [], 0
    for n in sizes:
        out.append(digits[at : at + n])
        at += n
    return gap.join(out)


def _mixed_case(r, n: int) -> str:
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    return "".join(letters[k] for k in r.integers(len(letters), size=n))


def _hex(r, n: int) -> str:
    return "".join("0123456789abcdef"[k] for k in r.integers(16, size=n))


def _example(r, kind: str, lang: str) -> tuple[str, str, str]:
    """(text before, span, text after) in one of the kind's forms."""
    d = lambda n: _digits(r, n)
    pick = lambda *some: str(some[int(r.integers(len(some)))])
    if kind == "email":
        name = pick(_plain(r), _plain(r), _word(r, lang)) + pick("", ".", "_", "-", "+") + pick(_plain(r), d(int(r.integers(1, 4))))
        host, top = _plain(r) + pick("", "", d(1)), pick("com", "org", "net", "de", "fr", "es", "co.uk", "example.com", "example.org")
        return "", pick(f"{name}@{host}.{top}", f"{name}@{host}.{top}", f"{name} @ {host}.{top}", f"{name}(at){host}.{top}", f"{name} (at) {host}.{top}", f"{name} [at] {host}.{top}", f"{name}[at]{host}[dot]{top}", f"{name} (at) {host} (dot) {top}"), ""
    if kind == "ip":
        four = [str(x) for x in r.integers(0, 256, 4)]
        six = [_hex(r, int(r.integers(1, 5))) for _ in range(8)]
        return "", pick(".".join(four), ".".join(four), "[.]".join(four), "(.)".join(four), ":".join(six), ":".join(six[:3]) + "::" + six[3], "2001:db8::" + ":".join(six[:2])), ""
    if kind == "card":
        n = int(r.choice([16, 16, 16, 15, 14, 13, 19]))
        gap = pick("", " ", "-", ".", "/", "_", "  ", " - ")
        sizes = {15: [4, 6, 5], 14: [4, 6, 4], 13: [4, 4, 5], 19: [4, 4, 4, 4, 3]}.get(n, [4, 4, 4, 4])
        return "", _grouped(_with_luhn(r, n), sizes, gap), ""
    if kind == "phone":
        a, b, c = d(3), d(3), d(4)
        return "", pick(f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{d(2)} {a} {b} {c}", f"0{d(2)} {b}{c}", f"{a}.{b}.{c}", f"00{d(2)} {a} {b}{c}", f"+{d(2)}{a}{b}{c}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}",
                        f"0{d(1)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"0{d(2)}/{d(7)}", f"0{d(3)} {d(6)}", f"(0{d(2)}) {d(3)} {d(4)}", f"9{d(1)} {d(3)} {d(2)} {d(2)}", f"6{d(2)} {d(3)} {d(3)}", f"0{d(3)}-{d(6)}", f"1-800-{b}-{c}"), ""
    value = pick(_hex(r, int(r.integers(16, 65))), _hex(r, 40), _mixed_case(r, int(r.integers(16, 48))), _plain(r) + d(int(r.integers(3, 7))) + pick("!", "#", "", "$"))
    name = pick("token", "secret", "password", "api_key", "key", "passwd", "access_token", "pwd", "apikey", "Bearer", "TOKEN", "API_KEY")
    before, after = (f'{name} = "', '"') if r.random() < 0.4 else (f"{name}=", "") if r.random() < 0.5 else (f"{name}: ", "") if r.random() < 0.7 else (f"{name}='", "'")
    if len(value) >= 32 and r.random() < 0.2:
        before, after = pick('"', "", "sk_", "ghp_"), '"' if r.random() < 0.3 else ""
    return before, value, after


def _decoy(r, lang: str) -> str:
    d = lambda n: _digits(r, n)
    w = lambda: _word(r, lang)
    forms = [f"20{d(2)}-{d(2)}-{d(2)}", f"{d(1)}.{d(1)}.", f"{d(2)}:{d(2)}", f"{d(2)}:{d(2)}:{d(2)}", f"${d(1)},{d(3)}.{d(2)}", f"{d(1)}.{d(2)}.{d(1)}", f"version {d(1)}.{d(1)}.", f"2.0.", d(int(r.integers(1, 9))), f"§ {d(2)}", f"{d(3)}%",
             f"@{w()}", f"{w()}@", f"[{d(2)}]", f"{d(2)}/{d(2)}/{d(4)}", f"{d(2)}.{d(2)}.{d(4)}", f'"{w()} {w()}"', f"{w()} = {w()}", f"{w()}={d(2)}", f"{d(1)}.{d(3)}.{d(3)}", f"{d(2)}-{d(2)}", f"({d(4)})", f"{d(4)}-{d(4)}", f"{w()}_{w()}", f"{d(1)}.{d(9)}",
             f"http://{_plain(r)}.com/{w()}", f"#{d(4)}", f"{w()}{d(2)}", f"CC BY {d(1)}.0", f"{d(3)} {w()} {d(2)}", f"={w()}=", f"{d(1)}e-{d(2)}", f"{d(3)},{d(3)},{d(3)}", f"no. {d(6)}", f"{d(5)} {w()}", f"{d(1)} {d(2)} {d(1)}", f"'{w()}'", f"a = b", f"===", f"(at {w()})", f"{w()}: {w()}",
             " ".join(d(1) + "00" for _ in range(3)), f"{d(1)},{d(3)} {d(3)}", f"{d(2)} {d(2)} {d(2)}", f"{d(2)}.{d(2)}.{d(2)}"]
    return str(forms[int(r.integers(len(forms)))])


def labelled_text(r, length: int) -> tuple[str, list[tuple[int, int, int]]]:
    """Synthetic text of at least `length` characters, and its spans (kind, start, end)."""
    lang = str(r.choice(list(_LANGS)))
    junk = r.random() < 0.2
    busy = r.random()
    text, marks = "", []
    while len(text) < length:
        what = r.random()
        if what < 0.15 * busy:
            k = int(r.integers(len(KINDS)))
            before, piece, after = _example(r, KINDS[k], lang)
            text += before
            marks.append((k, len(text), len(text) + len(piece)))
            text += piece + after
        elif what < 0.35 * busy:
            text += _decoy(r, lang)
        else:
            word = _word(r, lang)
            text += word.capitalize() if r.random() < (0.35 if lang == "de" else 0.12) else word.upper() if r.random() < 0.02 else word
        text += str(r.choice(["***", "%%%", "!!", "###", "$$$", "&&&"])) if junk and r.random() < 0.5 else ""
        text += str(r.choice([" ", " ", " ", " ", " ", " ", ", ", ". ", ".\n", "\n", "; ", ": "]))
    return text, marks


def labelled_windows(count: int, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, tags) of windows cut at random from synthetic text with formatted spans and decoys."""
    r = np.random.default_rng(seed)
    symbols, tags = np.zeros((count, length), np.int64), np.zeros((count, length), np.int64)
    for row in range(count):
        text, marks = labelled_text(r, 2 * length)
        line = np.zeros(len(text), np.int64)
        for k, a, b in marks:
            line[a] = 1 + 2 * k
            line[a + 1 : b] = 2 + 2 * k
        at = int(r.integers(len(text) - length))
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        symbols[row], tags[row] = symbols_of(codes[at : at + length]), line[at : at + length]
        if r.random() < 0.25:  # a text that ends inside the window
            ends = 1 + np.flatnonzero((tags[row, 1:] % 2 == 1) | (tags[row, 1:] == 0))
            end = int(ends[int(r.integers(len(ends)))])
            symbols[row, end:], tags[row, end:] = 0, 0
    return symbols, tags


def thresholds(model: Tagger, texts: int = 300, seed: int = 12, precision: float = PRECISION) -> list[float]:
    """By kind, the least certainty at which spans found in other synthetic text have the precision."""
    r = np.random.default_rng(seed)
    made = [labelled_text(r, 1500) for _ in range(texts)]
    found: list[list[tuple[float, bool]]] = [[] for _ in KINDS]
    for (_, marks), spans in zip(made, decoded_spans([t for t, _ in made], model), strict=True):
        gold = set(marks)
        for k, a, b, sure in spans:
            found[k].append((sure, (k, a, b) in gold))
    out = []
    for some in found:
        some.sort(reverse=True)
        good = np.cumsum([x for _, x in some])
        enough = np.flatnonzero(good >= precision * np.arange(1, len(some) + 1))
        out.append(some[enough[-1]][0] if len(enough) else 2.0)
    return out


@functools.lru_cache(maxsize=2)
def trained(windows: int = 9000, length: int = 64, rounds: int = 7, rate: float = 0.03, seed: int = 11) -> Tagger:
    """The tagger with its thresholds; the same in every process, and trained once in each."""
    model = Tagger(seed=seed)
    model.fit(*labelled_windows(windows, length, seed), rounds=rounds, batch=128, rate=rate, seed=seed)
    model.p["least"] = np.array(thresholds(model), np.float32)
    return model


# --- whole texts -------------------------------------------------------------------------------


def _stretches(text: str) -> list[tuple[int, int]]:
    """(start, windows) of each run of windows, at every half window, that have a trigger in them or in reach."""
    half = WINDOW // 2
    starts = sorted({b for m in _TRIGGER.finditer(text) for b in ((m.start() // half) * half, (m.start() // half) * half - half) if b >= 0})
    out: list[tuple[int, int]] = []
    for b in starts:
        if out and b == out[-1][0] + half * out[-1][1]:
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((b, 1))
    return out


def decoded_spans(texts: list[str], model: Tagger) -> list[list[tuple[int, int, int, float]]]:
    """(kind, start, end, certainty) of the spans that the tagger decodes in each text."""
    half, edge = WINDOW // 2, WINDOW // 4
    found: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    codes = [symbols_of(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)) if _TRIGGER.search(t) else None for t in texts]
    runs = sorted((n, k, b) for k, t in enumerate(texts) if codes[k] is not None for b, n in _stretches(t))
    at = 0
    while at < len(runs):
        some, windows = [], 0
        while at < len(runs) and (not some or windows + runs[at][0] <= TOGETHER):
            some.append(runs[at])
            windows += runs[at][0]
            at += 1
        rows = np.zeros((windows, WINDOW), np.int64)
        row = 0
        for n, k, b in some:
            for w in range(n):
                piece = codes[k][b + w * half : b + w * half + WINDOW]
                rows[row, : len(piece)] = piece
                row += 1
        scores = np.concatenate([model.emissions(rows[a : a + TOGETHER])[0] for a in range(0, windows, TOGETHER)], 1)
        longest = some[-1][0]
        joined = np.full((half * (longest + 1), len(some), TAGS), -100, np.float32)
        joined[:, :, 0] = 0
        row = 0
        for j, (n, k, b) in enumerate(some):
            for w in range(n):  # the middle half of each window, and the ends of the stretch
                first, last = 0 if w == 0 else edge, WINDOW if w == n - 1 else WINDOW - edge
                last = min(last, len(codes[k]) - b - w * half)
                if last > first:
                    joined[w * half + first : w * half + last, j] = scores[first:last, row]
                row += 1
        tags = model.viterbi(joined)
        used = np.flatnonzero(tags.any(1))
        sure = model.certainty(joined[:, used], tags[used]) if len(used) else []
        for j, p in zip(used, sure, strict=True):
            _, k, b = some[j]
            for kind, x, y in spans_of(tags[j]):
                found[k].append((kind, b + x, b + y, float(p[x:y].min())))
    return [sorted(f, key=lambda s: s[1]) for f in found]


def tagged_spans(texts: list[str], model: Tagger) -> list[list[tuple[str, int, int]]]:
    """Spans of each text that reach their kind's threshold and what a span must have."""
    least = model.p["least"]
    out: list[list[tuple[str, int, int]]] = []
    for text, spans in zip(texts, decoded_spans(texts, model), strict=True):
        sure = [(KINDS[k], a, b) for k, a, b, p in spans if p >= least[k]]
        each = [(kind, x, y) for kind, a, b in sure for x, y in (_cards(text, a, b) if kind == "card" else [(a, b)])]
        out.append([(kind, a, b) for kind, a, b in each if _has_least(text[a:b])])
    return out


def _has_least(piece: str) -> bool:
    return len(piece) >= LEAST_CHARS and _HELD.search(piece) is not None


def _cards(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The cards of a decoded stretch: all of it if its 13 to 19 digits pass Luhn's check; of more digits, from each
    run of digits on the fewest runs that do, so that cards written one after the other stay several."""
    runs = [(start + m.start(), start + m.end()) for m in re.finditer("[0-9]+", text[start:end])]
    digits = lambda some: "".join(text[a:b] for a, b in some)
    good = lambda d: 13 <= len(d) <= 19 and luhn(d)
    if sum(b - a for a, b in runs) <= 19:
        return [(start, end)] if good(digits(runs)) else []
    out, k = [], 0
    while k < len(runs):
        stop = next((j for j in range(k + 1, min(k + 19, len(runs)) + 1) if good(digits(runs[k:j]))), None)
        if stop:
            out.append((runs[k][0], runs[stop - 1][1]))
        k = stop or k + 1
    return out


def personal_data(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """doc_id, base and added (arrays of kind, start, end; base in the order of the kinds) of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast((model or trained()).p)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    as_rows = lambda spans: [dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = Tagger()
        own.p = shared.value
        texts = [t.decode("utf-8", "replace") for t in texts_of(batch["text"])]
        base = [base_spans(t) for t in texts]
        added = []
        for b, spans in zip(base, tagged_spans(texts, own), strict=True):
            taken = sorted((x, y) for _, x, y in b)
            begins = [x for x, _ in taken]
            ends = np.maximum.accumulate([y for _, y in taken]) if taken else np.empty(0)
            added.append([s for s in spans if not (n := int(np.searchsorted(begins, s[2], "left"))) or ends[n - 1] <= s[1]])
        return pa.record_batch({"doc_id": batch["doc_id"], "base": pa.array(map(as_rows, base), kind), "added": pa.array(map(as_rows, added), kind)})

    id_type = docs.schema["doc_id"].dataType.simpleString()
    span = "array<struct<kind:string,start:long,end:long>>"
    return map_batches(doc_view(docs, "doc_id", "text"), run, f"doc_id {id_type}, base {span}, added {span}")
