"""Plain versions of the corpus operators' contracts, one document at a time."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def repeats(docs: dict[int, str | None], window: int = 50) -> dict[int, tuple[int, int, str]]:
    """n_words, n_removed and the kept words' SHA-256 of each document."""
    first: dict[tuple, int] = {}
    for id_ in sorted(docs):
        own = words(docs[id_])
        for i in range(len(own) - window + 1):
            first.setdefault(tuple(own[i : i + window]), id_)
    out = {}
    for id_, text in docs.items():
        own = words(text)
        gone = set()
        for i in range(len(own) - window + 1):
            if first[tuple(own[i : i + window])] < id_:
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(own) if i not in gone)
        out[id_] = (len(own), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def statistics(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed of a text."""
    own = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    places = defaultdict(list)
    for i in range(len(own) - 7):
        places[tuple(own[i : i + 8])].append(i)
    covered = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    failed = len(own) < 20 or 100 * len(covered) > 30 * len(own)
    return len(own), sum(map(len, own)), len(SYMBOL.findall(text or "")), len(lines) - len(set(lines)), len(covered), failed


def fingerprint(text: str | None) -> int:
    own = words((text or "").translate(LOWER))
    if not own:
        return 0
    shingles = [own[i : i + 3] for i in range(len(own) - 2)] or [own]
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints: dict[int, int], most: int = 2) -> dict[int, int]:
    """The least id that links reach from each id."""
    by_print = defaultdict(list)
    for id_, x in prints.items():
        by_print[x].append(id_)
    root = {x: x for x in by_print}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    distinct = list(by_print)
    for i, x in enumerate(distinct):
        for y in distinct[:i]:
            if (x ^ y).bit_count() <= most:
                root[find(x)] = find(y)
    least: dict[int, int] = {}
    for x, ids in by_print.items():
        least[find(x)] = min([*ids, least.get(find(x), min(ids))])
    return {id_: least[find(x)] for id_, x in prints.items()}


def stored(text: str | None) -> tuple[int, int, str, int]:
    """n_bytes, payload_bytes, payload_sha256 and tail_crc32 of a text."""
    raw = (text or "").encode()
    payload = raw + b" " * (-len(raw) % 192 if raw else 192)
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])


def licenses(text: str | None) -> tuple[int, int, int | None, int | None, str]:
    """n_words, n_base, first_word, last_word and base_labels of a text."""
    own = LICENSE_WORD.findall((text or "").translate(LOWER))
    found = []
    for phrase, label in PHRASES.items():
        parts = phrase.split()
        found += [(i, label) for i in range(len(own)) if own[i : i + len(parts)] == parts]
    at = [i for i, _ in found]
    return len(own), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0) -> dict[str | None, float]:
    """Each source's share of all sizes by weight, no more than `most` times its own size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, stopped = {}, set()
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in stopped)
        total = sum(w for s, w in weight.items() if s not in stopped)
        out = {s: most * sizes[s] if s in stopped else left * weight[s] / total for s in order}
        over = {s for s in order if s not in stopped and out[s] > most * sizes[s]}
        if not over:
            return out
        stopped |= over
