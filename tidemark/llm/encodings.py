"""Texts that were decoded with a wrong character encoding: found, and restored where possible.

A span is a maximal run of letters, digits and non-ASCII characters with at least one non-ASCII character. For every
distinct span of the corpus all encode-decode chains are tried; a smoothed character trigram model, trained on the
spans of clean documents, scores what they give against the span as it stands.
"""

from __future__ import annotations

import codecs
import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.errors import ConfigError
from tidemark.functions.canon import col
from tidemark.session import Scratch, arrow_batches

# Encodings that UTF-8 or single-byte text is wrongly read in, and single-byte ones that it is written in.
READ_AS = ("cp1252", "latin_1", "mac_roman", "cp850", "cp437", "cp1251", "koi8_r", "cp866", "cp1250", "iso8859_2", "iso8859_15", "cp1253", "cp1254", "cp1257", "iso8859_7", "iso8859_9")
WRITTEN_IN = ("cp1252", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp866", "mac_roman", "cp850", "iso8859_5", "iso8859_15", "cp1253", "cp1254", "cp1257", "iso8859_7")
# Bytes that a decoder may have dropped, being controls or undefined in the encoding.
DROPPED = {"latin_1": frozenset(range(0x80, 0xA0)), "iso8859_15": frozenset(range(0x80, 0xA0)), "cp1252": frozenset((0x81, 0x8D, 0x8F, 0x90, 0x9D)), "cp1251": frozenset((0x98,))}
DEPTH = 3  # how often a text may have gone through UTF-8 wrongly

# A span from its first non-ASCII character on; what stands before is found backwards, so that ASCII text is only scanned.
TAIL = re.compile(r"[^\x00-\x7f](?:[0-9A-Za-z]|[^\x00-\x7f])*")
ALPHANUMERIC = frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
# Markup that shows characters as they are: \verb, code commands and verbatim environments.
SHOWN = re.compile(r"\\(?:verb|lstinline)\*?([^A-Za-z\s*{])[^\n]*?\1|\\(?:texttt|lstinline|code|url|path)\s*\{[^{}]*\}|\\begin\{(verbatim\*?|Verbatim|lstlisting|alltt)\}.*?\\end\{\2\}", re.S)
LOST = "\ufffd"
TEXTS_AT_ONCE, SPANS_AT_ONCE = 256, 1_000
UNDOUBTED = 25.0  # a reading through UTF-8 that gains this much is not given up for one between single bytes
SLOTS3, SLOTS2, POINTS = 1 << 21, 1 << 18, 0x110000
SIZE3, SIZE2, MASK = 2_097_143, 262_139, (1 << 64) - 1  # primes below the numbers of slots


_TABLES: dict = {}  # filled in each worker as needed


def byte_table(codec: str) -> str:
    """The 256 characters of a single-byte encoding; an undefined byte is the control character of its number."""
    if codec not in _TABLES:
        out = []
        for b in range(256):
            try:
                out.append(bytes([b]).decode(codec))
            except UnicodeDecodeError:
                out.append(chr(b))
        _TABLES[codec] = "".join(out)
    return _TABLES[codec]


def encoder(codec: str) -> dict[int, int]:
    """Code point to byte. Control characters 0x80-0x9f pass as their bytes, as lenient decoders leave them in."""
    if ("encoder", codec) not in _TABLES:
        found = {b: b for b in range(0x80, 0xA0)}
        _TABLES["encoder", codec] = found | {ord(ch): b for b, ch in enumerate(byte_table(codec))}
    return _TABLES["encoder", codec]


def _bits(sets: Sequence[Iterable[int]]) -> dict[str, int]:
    """Per character the bits of the sets that have its code point."""
    out: dict[str, int] = defaultdict(int)
    for i, points in enumerate(sets):
        for point in points:
            out[chr(point)] |= 1 << i
    return dict(out)


def _able(text: str, bits: dict[str, int], n: int) -> Iterator[int]:
    """Numbers of the sets that have all of a text's non-ASCII characters."""
    able = (1 << n) - 1
    for ch in set(text):
        if ch > "\x7f":
            able &= bits.get(ch, 0)
    while able:
        yield (able & -able).bit_length() - 1
        able &= able - 1


def decoded_as_utf8(text: str) -> Iterator[tuple[str, str]]:
    """(codec, reading) of each encoding in which the text's bytes are UTF-8."""
    if "readers" not in _TABLES:
        _TABLES["readers"] = _bits([encoder(c) for c in READ_AS])
    for i in _able(text, _TABLES["readers"], len(READ_AS)):
        try:
            yield READ_AS[i], codecs.charmap_encode(text, "strict", encoder(READ_AS[i]))[0].decode("utf-8")
        except UnicodeDecodeError:
            continue


def _translations() -> tuple[list[str], dict[str, list]]:
    """The chains of a wrong reading of one single-byte encoding as another, and per character what each makes of it, None if it does not take it."""
    if "translations" in _TABLES:
        return _TABLES["translations"]
    found = {}
    for read in READ_AS:
        for written in WRITTEN_IN:
            table = byte_table(written)
            mapping = {chr(point): table[b] for point, b in encoder(read).items() if b >= 0x80}
            if read != written:
                found.setdefault(tuple(sorted(mapping.items())), (f"{written}>{read}", mapping))
    chains = list(found.values())
    characters = {ch for _, mapping in chains for ch in mapping}
    _TABLES["translations"] = [chain for chain, _ in chains], {ch: [mapping.get(ch) for _, mapping in chains] for ch in characters}
    return _TABLES["translations"]


def _controls(text: str) -> bool:
    return any("\x7f" <= ch < "\xa0" for ch in text)


def _script(ch: str) -> str:
    """Latin, Cyrillic or Greek, empty for all else."""
    o = ord(ch)
    if not ch.isalpha():
        return ""
    return "Latin" if o < 0x250 or 0x1E00 <= o < 0x1F00 else "Greek" if 0x370 <= o < 0x400 else "Cyrillic" if 0x400 <= o < 0x530 else ""


def foreign(span: str) -> bool:
    """Whether a span holds what does not belong in one: a control character from 0x80 on, letters of two scripts, a symbol
    between letters, a capital after a small letter, or a letter between digits, the latter three above ASCII."""
    if any("\x80" <= ch < "\xa0" for ch in span):
        return True
    if len({_script(ch) for ch in span} - {""}) > 1:
        return True
    for before, ch, after in zip(span, span[1:], span[2:] + " "):
        if ch > "\x7f" and (
            (before.islower() and ch.isupper())
            or (before.isalpha() and after.isalpha() and unicodedata.category(ch) in ("Sm", "Sc", "Sk", "So", "Co"))
            or (before.isdigit() and after.isdigit() and ch.isalpha())
        ):
            return True
    return False


def a_word(span: str) -> bool:
    """At least two letters or digits: less is no evidence on its own, as a sign or an initial may just be rare."""
    return sum(ch.isalnum() for ch in span) >= 2


def telling(span: str) -> bool:
    """A word, or a span with a control character from 0x80 on, which no text has unless bytes were read wrongly."""
    return a_word(span) or any("\x80" <= ch < "\xa0" for ch in span)


def candidates(span: str) -> list[tuple[str, str, int]]:
    """(text, chain, kind) of every chain that gives another text: kind 0 through UTF-8, kind 1 between single bytes.

    A chain is written as it happened, e.g. utf_8>cp1252 is UTF-8 text read as cp1252. Single-byte chains that give the
    same text stand together, with | between them.
    """
    out: dict[str, tuple[str, int]] = {}
    front = [(span, "")]
    for _ in range(DEPTH):
        found = []
        for text, chain in front:
            for codec, back in decoded_as_utf8(text):
                if back != text and back not in out and back != span:
                    longer = f"utf_8>{codec} {chain}".strip()
                    out[back] = (longer, 0)
                    found.append((back, longer))
        front = [x for x in found if not x[0].isascii()]
    chains, takes = _translations()
    high = sorted({ch for ch in span if ch > "\x7f"})
    columns = [takes.get(ch) for ch in high]
    if None not in columns:
        images: dict[tuple, list[int]] = {}
        for i, image in enumerate(zip(*columns)):
            if None not in image:
                images.setdefault(image, []).append(i)
        for image, numbers in images.items():
            back = span.translate(dict(zip(map(ord, high), image)))
            if back != span and back not in out:
                out[back] = ("|".join(chains[i] for i in numbers), 1)
    return [(text, chain, kind) for text, (chain, kind) in out.items() if not _controls(text)]


def parts(text: str) -> Iterator[tuple[int, int, int]]:
    """Start, end and kind of the parts of a text: 0 plain, 1 a verbatim environment, 2 other markup that shows characters as they are."""
    at = 0
    for m in SHOWN.finditer(text) if "\\" in text else ():
        yield at, m.start(), 0
        yield m.start(), m.end(), 1 if m.group(2) else 2
        at = m.end()
    yield at, len(text), 0


def outside_shown(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of the parts of a text that are not shown as they are."""
    return ((start, end) for start, end, kind in parts(text) if not kind)


def span_places(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Start and end of the spans in a part of a text."""
    least = start
    for m in TAIL.finditer(text, start, end):
        i = m.start()
        while i > least and text[i - 1] in ALPHANUMERIC:
            i -= 1
        least = m.end()
        yield i, least


def spans_by_part(text: str) -> tuple[list[list[str]], bool]:
    """The distinct spans of each kind of part, and whether a replacement character is among the plain ones."""
    found: tuple[set[str], set[str], set[str]] = (set(), set(), set())
    for start, end, kind in parts(text):
        found[kind].update(text[i:j] for i, j in span_places(text, start, end))
    return [sorted(f) for f in found], any(LOST in s for s in found[0])


def spans_of(text: str) -> tuple[list[str], bool]:
    """The distinct spans outside shown parts, and whether a replacement character is among them."""
    found, lost = spans_by_part(text)
    return found[0], lost


def _slots3(a, b, c):
    return ((a * np.uint64(0x9E3779B1) + b * np.uint64(0x85EBCA6B)) * np.uint64(0x27D4EB2F) + c * np.uint64(0xC2B2AE35)) % np.uint64(SIZE3)


def _slots2(b, c):
    return (b * np.uint64(0x9E3779B1) + c * np.uint64(0x85EBCA6B)) % np.uint64(SIZE2)


def _points(spans: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all spans, each as two starts, its characters and an end; and the lengths."""
    joined = "".join(f"\x02\x02{s}\x03" for s in spans)
    return np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64), np.fromiter((len(s) + 3 for s in spans), dtype=np.int64, count=len(spans))


class NgramModel:
    """Smoothed character trigrams: a trigram backs off to the bigram, that to the character, that to one in 65 536.

    Counts are in tables of fixed size (hashed for trigrams and bigrams), about 14 MB whatever the corpus.
    """

    D1, D2, D3 = 10.0, 8.0, 4.0

    def __init__(self, n3: np.ndarray, n2: np.ndarray, n1: np.ndarray) -> None:
        self.n3, self.n2, self.n1 = n3, n2, n1
        self.total = float(n1.sum() - n1[2])
        self._steps: dict[str, float] = {}

    @staticmethod
    def count(spans: Sequence[str], weights: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The tables for weighted spans, to be added up."""
        p, lengths = _points(spans)
        w = np.repeat(np.asarray(weights, dtype=np.float64), lengths)
        at = np.flatnonzero(p != 2)
        first = np.cumsum(lengths) - lengths
        n3 = np.bincount(_slots3(p[at - 2], p[at - 1], p[at]).astype(np.int64), weights=w[at], minlength=SLOTS3)
        n2 = np.bincount(_slots2(p[at - 1], p[at]).astype(np.int64), weights=w[at], minlength=SLOTS2)
        n2 += np.bincount(_slots2(p[first], p[first + 1]).astype(np.int64), weights=w[first], minlength=SLOTS2)
        n1 = np.bincount(p[at].astype(np.int64), weights=w[at], minlength=POINTS)
        n1[2] += w[first].sum()
        return n3, n2, n1

    def scores(self, spans: Sequence[str], own: np.ndarray | float = 0.0) -> np.ndarray:
        """Log-probability of each span. `own` is taken off all counts: how often the span itself was trained on is left out."""
        if not len(spans):
            return np.zeros(0)
        p, lengths = _points(spans)
        at = np.flatnonzero(p != 2)
        less = np.repeat(np.broadcast_to(np.asarray(own, dtype=np.float64), lengths.shape), lengths - 2)
        c2, c1, c0 = p[at - 2], p[at - 1], p[at]

        ends = np.cumsum(lengths - 2) - (lengths - 2)
        return np.add.reduceat(self._log_p(c2, c1, c0, less), ends)

    def _log_p(self, c2: np.ndarray, c1: np.ndarray, c0: np.ndarray, less: np.ndarray | float = 0.0) -> np.ndarray:
        """Log-probability of c0 after c2 and c1. No count exceeds those of its parts, so what shares a slot with something common gains nothing."""
        a, b, c = (self.n1[x.astype(np.int64)] for x in (c2, c1, c0))
        ab, bc = np.minimum(self.n2[_slots2(c2, c1).astype(np.int64)], np.minimum(a, b)), np.minimum(self.n2[_slots2(c1, c0).astype(np.int64)], np.minimum(b, c))
        abc = np.minimum(self.n3[_slots3(c2, c1, c0).astype(np.int64)], np.minimum(ab, bc))
        b, c, ab, bc, abc = (np.maximum(x - less, 0.0) for x in (b, c, ab, bc, abc))
        p1 = (c + self.D1 / 65_536) / (self.total + self.D1)
        p2 = (bc + self.D2 * p1) / (b + self.D2)
        return np.log(np.minimum((abc + self.D3 * p2) / (ab + self.D3), 1.0))

    def lossy_keys(self, least: int = 5) -> dict[str, dict[str, list[str]]]:
        """Per encoding: how the UTF-8 bytes of known characters look in it when dropped bytes are gone."""
        known = [chr(x) for x in np.flatnonzero(self.n1 >= least) if 0x80 <= x and not 0xD800 <= x < 0xE000]
        out: dict[str, dict[str, list[str]]] = {}
        for codec, dropped in DROPPED.items():
            table, keys = byte_table(codec), defaultdict(list)
            for ch in known:
                raw = ch.encode("utf-8")
                whole, rest = "".join(table[b] for b in raw), "".join(table[b] for b in raw if b not in dropped)
                keys[whole].append(ch)
                if rest and rest != whole:
                    keys[rest].append(ch)
            out[codec] = dict(keys)
        return out

    def fill(self, span: str, keys: dict[str, list[str]]) -> str | None:
        """The likeliest reading of a span in which bytes were dropped: at each place one character stays or one to four
        stand for another. Exact, as a character's probability depends on the two before it, which are the state."""
        size = len(span)
        others = [[(i + n, ch) for n in (1, 2, 3, 4) if i + n <= size for ch in keys.get(span[i : i + n], ())] if span[i] > "\x7f" else () for i in range(size)]
        if not any(others):
            return None
        # Per place what was reached with a change, by the last two characters; without any change there is one way only.
        layers: list[dict[str, tuple[float, str]]] = [{} for _ in range(size + 1)]
        known, step = self._steps, self.step
        plain, before = 0.0, "\x02\x02"  # None once a control character stands before, which cannot stay

        for i, ch in enumerate(span):
            stays = not "\x7f" <= ch < "\xa0"
            options = [(i + 1, ch), *others[i]] if stays else others[i]
            ways = [(two, score, done, options) for two, (score, done) in layers[i].items()] if options else []
            if plain is not None and others[i]:
                ways.append((before, plain, span[:i], others[i]))
            for two, score, done, mine in ways:
                for at, other in mine:
                    three = two + other
                    gain = known.get(three)
                    total = score + (step(three) if gain is None else gain)
                    layer, state = layers[at], three[1:]
                    old = layer.get(state)
                    if old is None or total > old[0] or (total == old[0] and done + other > old[1]):
                        layer[state] = (total, done + other)
            if plain is not None:
                plain = plain + step(before + ch) if stays else None
                before = before[1] + ch
        ends = [(score + step(two + "\x03"), done) for two, (score, done) in layers[-1].items() if done != span]
        return max(ends)[1] if ends else None

    def step(self, three: str) -> float:
        """Log-probability of the last of three characters after the other two, remembered; _log_p of one."""
        found = self._steps.get(three)
        if found is None:
            x, y, z = map(ord, three)
            a, b, c = float(self.n1[x]), float(self.n1[y]), float(self.n1[z])
            ab = min(float(self.n2[(x * 0x9E3779B1 + y * 0x85EBCA6B) % SIZE2]), a, b)
            bc = min(float(self.n2[(y * 0x9E3779B1 + z * 0x85EBCA6B) % SIZE2]), b, c)
            abc = min(float(self.n3[(((x * 0x9E3779B1 + y * 0x85EBCA6B) * 0x27D4EB2F + z * 0xC2B2AE35) & MASK) % SIZE3]), ab, bc)
            p1 = (c + self.D1 / 65_536) / (self.total + self.D1)
            p2 = (bc + self.D2 * p1) / (b + self.D2)
            found = math.log(min((abc + self.D3 * p2) / (ab + self.D3), 1.0))
            if len(self._steps) > 1_000_000:
                self._steps.clear()
            self._steps[three] = found
        return found


def train(vocabulary: DataFrame) -> NgramModel:
    """The model of (span, n) with n > 0. What comes to the driver are the non-zero slots, at most those of the tables."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for b in batches:
            spans = b["span"].to_pylist()
            if spans:
                tables = NgramModel.count(spans, b["n"].to_numpy(zero_copy_only=False))
                sums = tables if sums is None else tuple(x + y for x, y in zip(sums, tables, strict=True))
        for order, table in enumerate(sums or ()):
            slots = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slots), order, dtype=np.int32)), pa.array(slots), pa.array(table[slots])], names=["part", "slot", "n"])

    rows = vocabulary.filter("n > 0").select("span", "n").mapInArrow(partial, "part int, slot bigint, n double").groupBy("part", "slot").agg(F.sum("n").alias("n")).toArrow()
    tables = [np.zeros(size) for size in (SLOTS3, SLOTS2, POINTS)]
    part, slot, n = (rows[c].to_numpy() for c in ("part", "slot", "n"))
    for order, table in enumerate(tables):
        mine = part == order
        table[slot[mine]] = n[mine]
    return NgramModel(*(t.astype(np.float32) for t in tables))


_OPTIONS = "span string, texts array<string>, chains array<string>, kinds array<int>"
_SCORED = "span string, n bigint, margin0 double, text0 string, chain0 string, margin1 double, text1 string, chain1 string, word boolean, odd boolean, credits0 array<struct<chain string, margin double>>, credits1 array<struct<chain string, margin double>>"


def _list_options(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [candidates(s) for s in b["span"].to_pylist()]
        columns = [b["span"], pa.array([[c[0] for c in f] for f in found], pa.list_(pa.string())), pa.array([[c[1] for c in f] for f in found], pa.list_(pa.string())), pa.array([[c[2] for c in f] for f in found], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, names=["span", "texts", "chains", "kinds"])


def _scorer(model):
    """Score the options of each span: per kind the best by how much likelier it is than the span as it stands."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm = NgramModel(*model.value)
        keys = lm.lossy_keys()
        leads = {codec: frozenset(k[0] for k in table) for codec, table in keys.items()}
        own9 = frozenset(byte_table("iso8859_15")) - frozenset(byte_table("latin_1"))
        for b in batches:
            spans, n = b["span"].to_pylist(), b["n"].to_numpy(zero_copy_only=False)
            base = lm.scores(spans, np.minimum(n, 1))
            texts, chains, kinds, rows = [], [], [], []
            for i, (t, c, k) in enumerate(zip(b["texts"].to_pylist(), b["chains"].to_pylist(), b["kinds"].to_pylist(), strict=True)):
                texts += t
                chains += c
                kinds += k
                rows += [i] * len(t)
                for codec, table in keys.items():
                    if codec == "iso8859_15" and own9.isdisjoint(spans[i]):
                        continue  # for others it is as latin_1
                    if not leads[codec].isdisjoint(spans[i]) and (filled := lm.fill(spans[i], table)) and filled not in t:
                        texts.append(filled)
                        chains.append(f"utf_8>{codec} with bytes dropped")
                        kinds.append(0)
                        rows.append(i)
            gains = lm.scores(texts) - base[rows] if texts else np.zeros(0)
            best: list[list] = [[(None, None, None)] * 2 for _ in spans]
            credits: list[list[dict]] = [[{}, {}] for _ in spans]
            # Only what is likelier than the span counts, and of the rest the best for each kind.
            place = np.asarray(rows, dtype=np.int64) * 2 + np.asarray(kinds, dtype=np.int64)
            most = np.full(2 * len(spans), -np.inf)
            np.maximum.at(most, place, gains)
            for c in np.flatnonzero((gains > 0) | (gains == most[place])).tolist():
                gain, text, chain, kind, i = float(gains[c]), texts[c], chains[c], kinds[c], rows[c]
                now = best[i][kind]
                if now[0] is None or (gain, text) > (now[0], now[1]):
                    best[i][kind] = (gain, text, chain.partition("|")[0])
                for one in chain.split("|") if gain > 0 else ():
                    credits[i][kind][one] = max(gain, credits[i][kind].get(one, 0.0))
            types = (pa.float64(), pa.string(), pa.string())
            columns = [pa.array([x[kind][j] for x in best], types[j]) for kind in (0, 1) for j in range(3)]
            likelier = [x[1][0] is not None and x[1][0] > 0 for x in best]
            columns.append(pa.array([yes and telling(s) for s, yes in zip(spans, likelier, strict=True)], pa.bool_()))
            columns.append(pa.array([yes and foreign(s) and not foreign(x[1][1]) for s, x, yes in zip(spans, best, likelier, strict=True)], pa.bool_()))
            pairs = pa.list_(pa.struct([("chain", pa.string()), ("margin", pa.float64())]))
            columns += [pa.array([[{"chain": c, "margin": g} for c, g in x[kind].items()] for x in credits], pairs) for kind in (0, 1)]
            yield pa.RecordBatch.from_arrays([b["span"], b["n"], *columns], names=["span", "n", "margin0", "text0", "chain0", "margin1", "text1", "chain1", "word", "odd", "credits0", "credits1"])

    return run


class Garbled:
    """documents: (doc_id, evidence, chain, chains, lost) of the affected; readings: (doc_id, part, span, text) to restore
    them by; shown: (doc_id, span, text, chain, margin) of what looks garbled, but is shown on purpose; margins: as
    validated; by_chain: the higher margins of single chains."""

    def __init__(self, documents: DataFrame, readings: DataFrame, shown: DataFrame, margins: tuple[float, float], by_chain: dict[str, float]) -> None:
        self.documents, self.readings, self.shown, self.margins, self.by_chain = documents, readings, shown, margins, by_chain


def find_garbled(
    documents: DataFrame,
    scratch: Scratch,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    rounds: int = 3,
    margins: tuple[float, float] = (4.0, 4.0),
    together: float = 25.0,
    false_share: float = 1e-3,
) -> Garbled:
    """The documents with characters that came from decoding bytes with a wrong encoding.

    A document is affected if, outside markup that shows characters as they are (\\verb, \\texttt, verbatim and the
    like), it has a replacement character, a span that one chain makes likelier by more than its kind's margin, or at
    least three spans that the same chain makes likelier by `together` in sum; a span counts for every chain that makes it
    likelier, by however little. The margins are in natural logarithms,
    for chains through UTF-8 and for those between single-byte encodings; between those, a span counts on its own only if
    it is a word or has a control character (telling). The first is validated on the spans of documents held to be clean: if more than false_share of
    their weight lies above the margin, it is raised until that is no more so. The second is validated for each chain, on
    documents that no chain through UTF-8 and no sum above `together` gives away: if more than false_share of the
    distinct spans that the chain can read, and more than three, lie above it, it is raised likewise for this chain.
    Words that the reading rids of what does not belong in a word (foreign) are evidence themselves; they neither count
    there nor need more than the margin given. Chains cover UTF-8 read as any of READ_AS up to three times over, UTF-8 read with bytes dropped on the way, and
    any of WRITTEN_IN read as another of READ_AS.

    Shown parts are scored as well. A verbatim environment is part of the text as it was decoded: if all of a document's
    spans in such environments, two at least, read better by one chain, by `together` in sum, the document is affected;
    a garbled example among others is not enough. What looks garbled in other shown parts is reported in `shown` only.

    Training starts from all documents, whose garbled part is small; each round trains on the documents that the one
    before left clean, and each span is scored as if it had been trained on in one document less. Every round scores every
    span anew, as a margin sums over all trigrams of a span and may rise far once garbled documents left the training.

    Scale: texts are read once and whole; only (document, spans) is kept, and all scoring is on distinct spans. Equal
    spans are counted map-side before the shuffle, so common ones are harmless; only suspicious spans are joined back
    to documents. The model has a fixed size.

    Defined cases: NULL and ASCII texts are not affected; repeated rows of a document give one row; NULL ids are left
    out; an empty table gives an empty result. Text that is garbled all through in a script that no clean document has,
    or only inside shown parts, is not recognised.
    """
    if rounds < 1 or min(margins) <= 0:
        raise ConfigError("rounds and margins must be positive")
    spark = documents.sparkSession
    d = documents.select(col(doc_id).alias("doc_id"), col(text).alias("text")).filter(F.col("doc_id").isNotNull() & (F.octet_length("text") > F.length("text")))

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [spans_by_part(t) for t in b["text"].to_pylist()]
            columns = [pa.array([f[0][kind] for f in found], pa.list_(pa.string())) for kind in (0, 1, 2)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *columns, pa.array([f[1] for f in found], pa.bool_())], names=["doc_id", "spans", "blocks", "inline", "lost"])

    kept = d.mapInArrow(extract, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, spans array<string>, blocks array<string>, inline array<string>, lost boolean")
    with arrow_batches(spark, TEXTS_AT_ONCE):
        kept = scratch.table(kept, "spans")
    # The model is trained on plain text and environments; examples shown in between are only scored.
    trained = kept.select(F.explode(F.array_union("spans", "blocks")).alias("span"), F.lit(1).alias("n"))
    words = trained.unionByName(kept.select(F.explode("inline").alias("span"), F.lit(0).alias("n")))
    vocabulary = scratch.table(words.groupBy("span").agg(F.sum("n").alias("n")), "vocabulary")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # named, so that few bytes are not gathered in few tasks
    with arrow_batches(spark, SPANS_AT_ONCE):
        options = scratch.table(vocabulary.select("span").repartition(tasks, "span").mapInArrow(_list_options, _OPTIONS), "options")
    counts = vocabulary
    for turn in range(rounds):
        last = turn + 1 == rounds
        model = train(counts)
        shared = spark.sparkContext.broadcast((model.n3, model.n2, model.n1))  # of fixed size
        weighed = options.join(counts, "span").select("span", "n", "texts", "chains", "kinds")
        with arrow_batches(spark, SPANS_AT_ONCE):
            scored = scratch.table(weighed.mapInArrow(_scorer(shared), _SCORED), f"scored{turn}")
        limit0 = _validated(scored, margins[0], false_share) if last else margins[0]
        suspects = scratch.table(scored.filter("margin0 > 0 OR margin1 > 0").select("span", *(F.coalesce(f"margin{k}", F.lit(-1e3)).alias(f"margin{k}") for k in (0, 1)), "text0", "text1", "chain0", "chain1", "word", "odd", "credits0", "credits1"), f"suspects{turn}")
        place = F.explode(F.concat(*(F.transform(c, _of_part(part)) for part, c in enumerate(("spans", "blocks", "inline")))))
        places = kept.select("doc_id", F.size("blocks").alias("n_blocks"), place.alias("p")).select("doc_id", "n_blocks", "p.*")
        hits = scratch.table(places.join(suspects, "span"), f"hits{turn}")
        by_chain = _validated_chains(hits.filter("part = 0"), options, limit0, margins[1], together, false_share) if last else {}
        limit1 = F.lit(margins[1])
        for chain, limit in by_chain.items():
            limit1 = F.when(F.col("chain1") == chain, F.lit(limit)).otherwise(limit1)
        through_utf8 = F.col("margin0") >= F.least(F.col("margin1"), F.lit(UNDOUBTED))
        clear1 = F.col("word") & (F.col("margin1") > F.when(F.col("odd"), F.lit(margins[1])).otherwise(limit1))
        clear0 = F.col("margin0") > limit0
        hits = hits.select("doc_id", "part", "n_blocks", "span", F.when(through_utf8, F.col("text0")).otherwise(F.col("text1")).alias("text"), F.when(through_utf8, F.col("chain0")).otherwise(F.col("chain1")).alias("chain"), F.when(through_utf8, F.col("credits0")).otherwise(F.col("credits1")).alias("credits"), (clear0 | clear1).alias("clear"))
        credited = hits.select("doc_id", "part", "n_blocks", F.explode("credits").alias("credit"), "clear")
        evidence = credited.groupBy("doc_id", "part", F.col("credit.chain").alias("chain")).agg(F.sum("credit.margin").alias("evidence"), F.count(F.lit(1)).alias("spans"), F.max("clear").alias("clear"), F.max("n_blocks").alias("n_blocks"))
        plain = (F.col("part") == 0) & (F.col("clear") | ((F.col("spans") >= 3) & (F.col("evidence") > together)))
        block = (F.col("part") == 1) & (F.col("spans") >= 2) & (F.col("spans") == F.col("n_blocks")) & (F.col("evidence") > together)
        sure = evidence.filter(plain | block)
        lost = kept.filter("lost").select("doc_id", F.lit(None).cast("string").alias("chain"), F.lit(0.0).alias("evidence"), F.lit(True).alias("lost"))
        rows = sure.select("doc_id", "chain", "evidence", F.lit(False).alias("lost")).unionByName(lost)
        affected = scratch.table(rows.groupBy("doc_id").agg(F.max("evidence").alias("evidence"), F.max(F.struct("evidence", "chain"))["chain"].alias("chain"), F.collect_set("chain").alias("chains"), F.max("lost").alias("lost")), f"affected{turn}")
        if not last:
            gone = kept.join(affected.select("doc_id"), "doc_id", "left_semi").select(F.explode(F.array_union("spans", "blocks")).alias("span")).groupBy("span").agg(F.count(F.lit(1)).alias("gone"))
            counts = scratch.table(vocabulary.join(gone, "span", "left").select("span", (F.col("n") - F.coalesce("gone", F.lit(0))).alias("n")), f"counts{turn}")
        shared.unpersist()
    shown = hits.filter("part = 2 AND clear").select("doc_id", "span", "text", "chain", F.array_max("credits.margin").alias("margin"))
    # A span is read anew where it is clear by itself, or where a chain that the document is affected by makes it likelier.
    known = hits.filter("part < 2").join(affected.select("doc_id", "chains"), "doc_id")
    same = F.arrays_overlap("credits.chain", "chains")
    readings = known.filter(same | (F.col("clear") & (F.col("part") == 0))).select("doc_id", "part", "span", "text")
    return Garbled(affected, readings, shown, (limit0, margins[1]), by_chain)


def _of_part(part: int):
    return lambda span: F.struct(F.lit(part).alias("part"), span.alias("span"))


def _raised(rows: list, allowed: float, least: float) -> float:
    """The margin, at least `least`, that no more than `allowed` of the counts n by quarter lie above."""
    above = 0
    for r in sorted(rows, key=lambda r: -r["quarter"]):
        above += r["n"]
        if above > allowed:
            return max(least, (r["quarter"] + 1) / 4)
    return least


def _quarter(margin: str):
    return F.floor(F.greatest(F.least(F.coalesce(F.col(margin), F.lit(-50.0)), F.lit(100.0)), F.lit(-50.0)) * 4).alias("quarter")


def _validated(scored: DataFrame, least: float, false_share: float) -> float:
    """The margin through UTF-8 that at most false_share of the weight of clean spans exceeds. At most 600 rows come to the driver."""
    rows = scored.groupBy(_quarter("margin0")).agg(F.sum("n").alias("n")).collect()
    return _raised(rows, false_share * sum(r["n"] for r in rows), least)


def _validated_chains(hits: DataFrame, options: DataFrame, limit0: float, least: float, together: float, false_share: float) -> dict[str, float]:
    """The single-byte chains that need a margin above `least`. At most 400 rows for each chain come to the driver."""
    plain = hits.filter(F.col("word") & ~F.col("odd") & (F.col("margin1") > least))
    sums = hits.groupBy("doc_id", "chain1").agg(F.sum(F.greatest("margin1", F.lit(0.0))).alias("evidence"), F.max("margin0").alias("margin0"))
    firm = sums.filter((F.col("evidence") > together) | (F.col("margin0") > limit0)).select("doc_id").distinct()
    above = plain.join(firm, "doc_id", "left_anti").select("span", "chain1", "margin1").distinct().groupBy("chain1", _quarter("margin1")).agg(F.count(F.lit(1)).alias("n")).collect()
    if not above:
        return {}
    read = options.select(F.explode(F.arrays_zip("chains", "kinds")).alias("o")).filter("o.kinds = 1").select(F.explode(F.split("o.chains", "[|]")).alias("chain")).groupBy("chain").agg(F.count(F.lit(1)).alias("n"))
    spans = {r["chain"]: r["n"] for r in read.collect()}
    found = {chain: _raised([r for r in above if r["chain1"] == chain], max(false_share * spans.get(chain, 0), 3), least) for chain in {r["chain1"] for r in above}}
    return {chain: limit for chain, limit in found.items() if limit > least}


def restore(documents: DataFrame, garbled: Garbled, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, restored): the affected documents with their spans as they were written.

    Spans that no chain makes likelier stay as they are, and so do shown parts other than verbatim environments, and
    replacement characters, whose originals are lost.
    """
    ids = garbled.documents.select(F.col("doc_id").alias("__id"))
    d = documents.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    d = d.join(ids, d["doc_id"] == ids["__id"], "left_semi").dropDuplicates(["doc_id"])
    id_type = d.schema["doc_id"].dataType.simpleString()
    changes = garbled.readings.groupBy("doc_id").agg(F.collect_list(F.struct("part", "span", F.col("text").alias("reading"))).alias("changes"))
    both = d.join(changes, "doc_id", "left").select("doc_id", "text", "changes")

    def rewrite(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = []
            for whole, changes in zip(b["text"].to_pylist(), b["changes"].to_pylist(), strict=True):
                to = {(c["part"], c["span"]): c["reading"] for c in changes or ()}
                out, at = [], 0
                for start, end, kind in parts(whole):
                    for i, j in span_places(whole, start, end):
                        out += [whole[at:i], to.get((kind, whole[i:j]), whole[i:j])]
                        at = j
                done.append("".join([*out, whole[at:]]))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["text"], pa.array(done, pa.string())], names=["doc_id", "text", "restored"])

    return both.mapInArrow(rewrite, f"doc_id {id_type}, text string, restored string")
