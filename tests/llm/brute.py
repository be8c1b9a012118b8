"""Plain versions of the operators over small tables, written from the contracts alone."""

from __future__ import annotations

import hashlib
import re

import xxhash

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fingerprint(text: str | None) -> int:
    words = SPACED.findall((text or "").translate(ASCII_LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints: dict[int, int], distance: int = 4) -> dict[int, int]:
    """doc_id to the least doc_id it reaches."""
    root = {d: d for d in prints}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def contamination(docs, items) -> list[tuple]:
    windows: dict[tuple, set[str]] = {}
    for item, text in items:
        words = PLAIN.findall((text or "").translate(ASCII_LOWER))
        for k in range(max(1, len(words) - 9) if words else 0):
            windows.setdefault(tuple(words[k : k + 10]), set()).add(str(item))
    out = []
    for doc_id, text in docs:
        words = PLAIN.findall((text or "").translate(ASCII_LOWER))
        hit, found = set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                window = tuple(words[k : k + n])
                if window in windows:
                    hit.update(range(k, k + n))
                    found |= windows[window]
        out.append((doc_id, len(words), len(hit), len(found), sha256(",".join(sorted(found))), bool(hit)))
    return out


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def _holds(kind: str, match: str) -> bool:
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in doubled) % 10 == 0
    return True


def personal_data(docs) -> list[tuple]:
    out = []
    for doc_id, text in docs:
        spans = [(k, m.start(), m.end()) for k, p in BASE.items() for m in p.finditer(text or "") if _holds(k, m[0])]
        counts = [sum(s[0] == k for s in spans) for k in BASE]
        out.append((doc_id, *counts, sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans))))
    return out


def repetition(docs) -> list[tuple]:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    out = []
    for doc_id, text in docs:
        text = text or ""
        words = SPACED.findall(text)
        lines = [x for x in text.split("\n") if SPACED.search(x)]
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        symbols = len(re.findall(r"[#*$%&|<>]", text))
        out.append((doc_id, len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed))
    return out


def repeats(docs) -> list[tuple]:
    seen, out = set(), []
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            window = data[p : p + 100]
            if window in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(window)
        spans = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        kept = bytes(b for b, x in zip(data, gone) if not x)
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
