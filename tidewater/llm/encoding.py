"""Garbled text from a wrong character encoding.

Statistics of adjacent characters are counted over the distinct lines of all documents, so that copies add no evidence. The score of a pair is its pointwise mutual information;
pairs that some wrong decoding would have made out of one character are set aside when the information is estimated,
since their counts tell as much about damage as about language, and get the least information. A pair's score is how far
its information lies below IMPROBABLE; the maximum-scoring segments of a text are the runs in which alone inverse mappings
are tried. A repair
counts if it turns the run into valid text whose signs fit their neighbours by the same information.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The single-byte encodings as which UTF-8 is read by mistake (fixed values, most usual first).
WRONG = ("cp1252", "latin-1", "cp1250", "mac_roman", "cp437", "cp850", "iso8859_15", "cp1254", "iso8859_2", "cp1251", "cp1257")
#: Single-byte encodings that a text may have had when another one was used (fixed values).
RIGHT = ("cp1252", "mac_roman", "cp850")
#: Words that announce a sign as an example (fixed values), for a replacement sign that nothing can restore.
MENTIONS = re.compile(r"\b(?:signs?|characters?|symbols?|letters?|sequences?|glyphs?|zeichen|symbole?|buchstaben?|signes?|caract[eè]res?|signos?|s[ií]mbolos?|letras?|segn[oi]|simbol[oi]|letter[ae]|caratter[ei])\W{0,3}$", re.IGNORECASE)
OTHERS = 64
IMPROBABLE = -3.0
#: Limits of a pair's score.
GAIN, LOSS = 6.0, 1.0


def _reverse(codec: str) -> dict[int, int]:
    """Code point to byte; bytes without a character stand for the control character of the same number."""
    table = {}
    for b in range(256):
        try:
            table[ord(bytes([b]).decode(codec))] = b
        except UnicodeDecodeError:
            pass
    for b in range(128, 256):
        if b not in table.values():
            table.setdefault(b, b)
    return table


REVERSE = {codec: _reverse(codec) for codec in WRONG}
FORWARD = {codec: {b: cp for cp, b in table.items()} for codec, table in REVERSE.items()}


class Alphabet:
    """Small identifiers for characters: ASCII and all characters of the wrong encodings one each, others by block."""

    def __init__(self) -> None:
        own = sorted({cp for table in REVERSE.values() for cp in table} | set(range(256)) | set(range(0x2010, 0x2040)))
        self.size = len(own) + OTHERS
        self.ids = np.empty(0x110000, dtype="uint16")
        self.ids[:] = len(own) + (np.arange(0x110000) >> 7) % OTHERS
        self.ids[own] = np.arange(len(own))
        self.own = own

    def joined(self, seen: np.ndarray) -> np.ndarray:
        """The pairs that a wrong decoding makes out of one character: next to each other in the misread bytes of a
        character that is ``seen``."""
        joins = np.zeros((self.size, self.size), dtype=bool)
        for cp in self.own:
            if cp < 0x80 or not seen[self.ids[cp]]:
                continue
            raw = chr(cp).encode("utf-8")
            for table in FORWARD.values():
                parts = [self.ids[table[b]] for b in raw]
                for x, y in zip(parts, parts[1:]):
                    joins[x, y] = True
        return joins

    def confused(self, counts: np.ndarray, times: float = 20.0) -> np.ndarray:
        """The pairs that reading one single-byte encoding as another makes out of a pair far more frequent."""
        out = np.zeros((self.size, self.size), dtype=bool)
        for wrong in WRONG:
            for right in RIGHT:
                if wrong == right:
                    continue
                to = np.arange(self.size)
                for cp, b in REVERSE[wrong].items():
                    if b >= 0x80:
                        try:
                            meant = bytes([b]).decode(right)
                            to[self.ids[cp]] = self.ids[ord(meant)] if meant.isalpha() else to[self.ids[cp]]
                        except UnicodeDecodeError:
                            pass
                meant = counts[np.ix_(to, to)]
                out |= (counts > 0) & (meant >= times) & (meant >= times * counts)
        return out

    def of(self, text: str) -> np.ndarray:
        return self.ids[np.frombuffer(text.encode("utf-32-le", "replace"), dtype="uint32")]


_alphabet: Alphabet | None = None


def alphabet() -> Alphabet:
    global _alphabet
    if _alphabet is None:
        _alphabet = Alphabet()
    return _alphabet


def pair_counts(texts: DataFrame) -> DataFrame:
    """pair, n: how often two characters are adjacent, over the distinct lines of all texts, so that a text that is copied,
    alone or inside of others, counts once. Lines are shuffled once; of the counts, a task sends those that aren't zero."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = alphabet()
        total = np.zeros(a.size * a.size, dtype="int64")
        for batch in batches:
            ids = a.of("\n".join(batch["text"])).astype("int64")
            for lo in range(0, max(0, len(ids) - 1), 4_000_000):
                part = ids[lo : lo + 4_000_001]
                total += np.bincount(part[:-1] * a.size + part[1:], minlength=len(total))
        at = np.nonzero(total)[0]
        if len(at):
            yield pd.DataFrame({"pair": at, "n": total[at]})

    lines = texts.select(F.explode(F.split("text", "\n")).alias("text")).where(F.length("text") > 0).distinct()
    return lines.mapInPandas(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


class Information:
    """Pointwise mutual information of adjacent characters."""

    def __init__(self, rows: list[tuple[int, int]]) -> None:
        a = alphabet()
        counts = np.zeros(a.size * a.size)
        for pair, n in rows:
            counts[pair] = n
        counts = counts.reshape(a.size, a.size)
        seen = counts.sum(axis=1) + counts.sum(axis=0)
        joins = a.joined(seen >= max(6.0, 1e-6 * counts.sum()))
        joins |= a.confused(counts)
        counts[joins] = 0.0
        total = max(1.0, counts.sum())
        first, second = counts.sum(axis=1) + 0.5, counts.sum(axis=0) + 0.5
        self.counts = counts
        self.usual = (counts.sum(axis=0) + counts.sum(axis=1) >= 6) & (np.arange(a.size) < a.size - OTHERS)
        self.pmi = (np.log((counts + 0.02) * total) - np.log(first)[:, None] - np.log(second)[None, :]).astype("float32")
        # only pairs with a sign beyond ASCII can be damage, and those
        # that a decoding would join were set aside; replacement and control signs carry no information either
        lost = a.ids[0xFFFD]
        self.lost = int(lost)
        joins[lost, :] = joins[:, lost] = True
        joins[a.ids[0x80:0xA0], :] = joins[:, a.ids[0x80:0xA0]] = True
        self.pmi[joins] = IMPROBABLE - GAIN
        self.score = np.clip(IMPROBABLE - self.pmi, -LOSS, GAIN)
        self.score[np.ix_(a.ids[:128], a.ids[:128])] = -LOSS
        self.bad = self.score > 0

    def fits(self, left: str, right: str, least: float = 0.0) -> bool:
        """Whether two characters belong together: information of ``least`` or more on some evidence."""
        i, j = alphabet().of(left + right)
        return bool(self.counts[i, j] >= 3 and self.pmi[i, j] >= least)

    def total(self, text: str) -> float:
        """The summed information of the adjacent pairs of a short text, each between -6 and 3."""
        ids = alphabet().of(text)
        return float(np.clip(self.pmi[ids[:-1], ids[1:]], -6.0, 3.0).sum())

    def segments(self, text: str, ids: np.ndarray | None = None) -> list[tuple[int, int]]:
        """The maximum-scoring segments of improbable pairs, as character spans [begin, end)."""
        ids = alphabet().of(text) if ids is None else ids
        if len(ids) < 2:
            return [(0, 1)] if len(ids) and ids[0] == self.lost else []
        scores = self.score[ids[:-1], ids[1:]]
        sums = np.concatenate([[0.0], np.cumsum(scores, dtype=float)])
        out: list[tuple[int, int]] = []
        # between two positive pairs lie only others, so a segment goes on while its sum stays above zero
        begin = end = None
        total = 0.0
        for h in np.nonzero(scores > 0)[0].tolist():
            if begin is not None and total + sums[h] - sums[end + 1] > 0:
                total += sums[h + 1] - sums[end + 1]
                end = h
            else:
                if begin is not None:
                    out.append((begin, end + 2))
                begin, end, total = h, h, float(scores[h])
        if begin is not None:
            out.append((begin, end + 2))
        return out


def fit_information(texts: DataFrame) -> Information:
    """From counts over all distinct lines; at most alphabet x alphabet numbers reach the driver."""
    return Information([(r.pair, r.n) for r in pair_counts(texts).collect()])


_HIGH = re.compile("[^\x00-\x7f]+")


def _decoded(piece: str, codec: str) -> str | None:
    """``piece`` with its signs beyond ASCII taken back to bytes and read as UTF-8; None if that fails."""
    table = REVERSE[codec]
    raw = bytearray()
    for c in piece:
        b = table.get(ord(c))
        if b is None:
            return None
        raw.append(b)
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if len(text) < len(piece) else None


def _forms(piece: str) -> set[str]:
    """All readings of a piece by the inverse mappings, also of what was decoded wrongly more than once."""
    found: set[str] = set()
    step = {piece}
    for _ in range(3):
        step = {t for p in step for codec in WRONG if (t := _decoded(p, codec)) is not None} - found
        found |= step
    return found


def _stretches(piece: str) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """The parts of a run whose bytes are whole UTF-8 sequences in some wrong encoding, as long as they go, each with the
    parts that are one character. A sequence shows where it begins, so one pass per encoding finds them, however long."""
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for codec in WRONG:
        table = REVERSE[codec]
        raw = [table.get(ord(c), 0) for c in piece]
        i, signs = 0, []
        while i <= len(raw):
            lead = raw[i] if i < len(raw) else 0
            size = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
            if size and i + size <= len(raw) and all(0x80 <= b <= 0xBF for b in raw[i + 1 : i + size]):
                signs.append((i, i + size))
                i += size
                continue
            if signs:
                out[signs[0][0], signs[-1][1]] = signs
            signs, i = [], i + 1
    return out


def _single(piece: str, wrong: str, right: str) -> str | None:
    """``piece`` as the bytes that ``wrong`` read, read by the single-byte encoding ``right``."""
    table = REVERSE[wrong]
    try:
        return bytes(table[ord(c)] for c in piece).decode(right)
    except (KeyError, UnicodeDecodeError):
        return None


def _fit_share(left: str, fixed: str, right: str, info: Information, least: float) -> float:
    pairs = list(zip(left + fixed, fixed + right)) if left else list(zip(fixed, fixed[1:] + right))
    return sum(info.fits(x, y, least) for x, y in pairs) / max(1, len(pairs))


Change = tuple[int, int, str]


class Repairer:
    """Repairs texts; remembers what became of a run between two neighbours."""

    def __init__(self, info: Information) -> None:
        self.info = info
        self.known: dict[tuple[str, str, str], list[Change]] = {}

    def run(self, before: str, piece: str, after: str) -> list[Change]:
        """begin, end and restored form of the parts of a run to replace; an end beyond the run takes a space with it."""
        key = (before, piece, after)
        if key not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[key] = self._run(before, piece, after)
        return self.known[key]

    def _run(self, before: str, piece: str, after: str) -> list[Change]:
        n, alone = len(piece), not (before.isalnum() or after[:1].isalnum())

        def best(lo: int, hi: int, tail: str) -> tuple | None:
            left, right = (piece[lo - 1] if lo else before), (piece[hi] if hi < n else after[:1] if not tail else after[1:])
            found = None
            for fixed in _forms(piece[lo:hi] + tail):
                share = _fit_share(left, fixed, right, self.info, -1.5)
                # inside a word, a sign that the corpus uses elsewhere may stand in a place where it was not seen before
                # (and three characters in a row are no example of a sign)
                if share >= (1.0 if alone and len(fixed) < 3 else 0.5) or (not alone and self.info.usual[alphabet().of(fixed)].all()):
                    found = max(found or (), (hi - lo + len(tail), -len(fixed), share, fixed, lo, hi + len(tail)))
            return found

        found = []
        # a byte that stands for a no-break space may have become an ordinary one
        tails = ["", "\xa0"] if after[:1] == " " and (before.isalpha() or after == "  ") else [""]
        for tail in tails:
            for (lo, hi), signs in _stretches(piece + tail).items():
                whole = best(lo, min(hi, n), tail if hi > n else "")
                parts = [whole] if whole else [best(a, min(b, n), tail if b > n else "") for a, b in signs] if len(signs) > 1 else []
                found += [f for f in parts if f]
        changes: list[Change] = []
        for _, _, _, fixed, lo, hi in sorted(found, reverse=True):
            if all(hi <= a or b <= lo for a, b, _ in changes):
                changes.append((lo, hi, fixed))
        return sorted(changes)

    def __call__(self, text: str) -> tuple[str, int, bool]:
        """The text with all restorable runs restored, the number of restored pieces, and whether damage is left."""
        info, left = self.info, False
        runs: list[tuple[int, int]] = []
        for begin, end in info.segments(text):
            for m in _HIGH.finditer(text, begin, end):
                a, b = m.span()
                while a > 0 and text[a - 1] > "\x7f":
                    a -= 1
                while b < len(text) and text[b] > "\x7f":
                    b += 1
                if not runs or a >= runs[-1][1]:
                    runs.append((a, b))
        changes, kept = [], []
        for a, b in runs:
            found = self.run(text[max(0, a - 1) : a], text[a:b], text[b : b + 2] if text[b : b + 2] == "  " else text[b : b + 1])
            changes += [(a + lo, a + hi, fixed) for lo, hi, fixed in found]
            rest = text[a:b] if not found else "".join(text[a:b][x:y] for x, y in zip([0, *(hi for _, hi, _ in found)], [*(lo for lo, _, _ in found), b - a]))
            if "\ufffd" in rest:
                left |= not _mentioned(text, a, b)
            elif not found:
                kept.append((a, b))
        changes += (single := self._single_bytes(text, kept)) if kept else (single := [])
        mended = {(a, b) for a, b, _ in single}
        # control signs stand in no sound text
        left |= any("\x80" <= c <= "\x9f" for a, b in kept if (a, b) not in mended for c in text[a:b])
        out, last = [], 0
        for a, b, fixed in sorted(changes):
            out += [text[last:a], fixed]
            last = b
        return "".join([*out, text[last:]]), len(changes), left

    def _single_bytes(self, text: str, runs: list[tuple[int, int]]) -> list[Change]:
        """One wrong single-byte encoding for another: the mapping under which most runs gain, if clearly all do."""
        info, best = self.info, None
        for wrong in WRONG:
            for right in RIGHT:
                if wrong == right:
                    continue
                won, gain, fixes = 0, 0.0, []
                for a, b in runs:
                    fixed = _single(text[a:b], wrong, right)
                    if fixed is None or fixed == text[a:b]:
                        continue
                    old = info.total(text[max(0, a - 1) : b + 1])
                    new = info.total(text[max(0, a - 1) : a] + fixed + text[b : b + 1])
                    share = _fit_share(text[a - 1 : a], fixed, text[b : b + 1], info, -1.5)
                    gain += new - old
                    if share == 1.0 and new - old > 2.0 and (fixed.isalpha() or fixed in "’'"):
                        won += 1
                        fixes.append((a, b, fixed))
                if won >= 2 and won >= 0.6 * len(runs) and gain > 4.0 * won and (best is None or (won, gain) > best[:2]):
                    best = (won, gain, fixes)
        return best[2] if best else []


def _mentioned(text: str, a: int, b: int) -> bool:
    """Whether a sign stands by itself and is announced as an example, or is quoted alone."""
    before, after = text[max(0, a - 40) : a], text[b : b + 1]
    quoted = before[-1:] in "“\"'«‘„(" and after in tuple("”\"'»’“)") and before[-1:] != ""
    return quoted or (not (before[-1:].isalnum() or after.isalnum()) and bool(MENTIONS.search(before)))


def repair(df: DataFrame, info: Information, keys: list[str]) -> DataFrame:
    """keys, restored, pieces, unrestorable of every garbled text.

    restored is the whole text with every run restored that an inverse mapping explains, of any length. Texts that are
    NULL, empty, in ASCII, or rightly use unusual signs, entities or cited signs have no row. unrestorable says that
    replacement or control signs are left, also beside restored runs. Equal texts get equal rows; further columns are ignored.
    """
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fix: Repairer | None = None
        for batch in batches:
            at, text_out, pieces, lost = [], [], [], []
            texts = batch["text"].tolist()
            fix = Repairer(info) if fix is None else fix
            high = [i for i, t in enumerate(texts) if not t.isascii()]
            if high:
                # one look-up over the whole batch finds the few texts with an improbable pair
                joined = alphabet().of("\n".join(texts[i] for i in high))
                lengths = np.array([len(texts[i]) for i in high])
                starts = np.cumsum(lengths + 1) - lengths - 1
                hits = np.nonzero(info.bad[joined[:-1], joined[1:]])[0] if len(joined) > 1 else np.zeros(0, dtype=int)
                for k in np.unique(np.searchsorted(starts, hits, side="right") - 1).tolist():
                    text, done, left = fix(texts[high[k]])
                    if done or left:
                        at.append(high[k])
                        text_out.append(text)
                        pieces.append(done)
                        lost.append(left)
            if at:
                yield pd.DataFrame({k: batch[k].to_numpy()[at] for k in keys} | {"restored": text_out, "pieces": np.array(pieces, dtype="int32"), "unrestorable": np.array(lost, dtype=bool)})

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", restored string, pieces int, unrestorable boolean"
    return df.select(*keys, "text").where(F.length("text") > 0).mapInPandas(run, schema)
