"""Plain versions of the operators, for small fixtures."""

from __future__ import annotations

import hashlib
import re
from itertools import combinations

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def upper_az_down(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def simhash(text: str | None, shingle: int = 4) -> int:
    words = WORD.findall(upper_az_down(text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def near_classes(rows: list[tuple[int | None, str | None]], max_bits: int = 4) -> list[tuple[int | None, str, int | None]]:
    prints = [simhash(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i: int) -> int:
        while label[i] != i:
            i = label[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= max_bits:
            label[root(j)] = root(i)
    classes: dict[int, list[int]] = {}
    for i, (doc_id, _) in enumerate(rows):
        classes.setdefault(root(i), []).extend([] if doc_id is None else [doc_id])
    return [(d, f"{prints[i]:016x}", min(classes[root(i)], default=None)) for i, (d, _) in enumerate(rows)]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    )
    return [(kind, m.start(), m.end()) for kind, pattern, fits in rules for m in re.finditer(pattern, text) if fits(m)]


def span_digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def quality_base(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def judged(url: str | None, rules: list[tuple[str, str, str]]) -> tuple[str, str, str | None, str]:
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = upper_az_down(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
    fitting = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fitting, default=(0, 0, False, None, "allow"))
    return host, path, best[3], best[4]


def tokens(text: str | None) -> list[str]:
    return re.sub(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", " ", (text or "").lower()).split()


def holds(doc: str | None, item: str | None, least: int = 13, share: float = 0.8) -> bool:
    """Some diagonal has a stretch of the largest sum (equal 1, other −3) that is long and equal enough."""
    d, t = tokens(doc), tokens(item)
    for shift in range(-len(t) + 1, len(d)):
        best, equal = (0, 0), [d[i] == t[i - shift] for i in range(max(0, shift), min(len(d), shift + len(t)))]
        for i in range(len(equal)):
            for j in range(i + 1, len(equal) + 1):
                part = equal[i:j]
                best = max(best, (sum(part) - 3 * (len(part) - sum(part)), len(part)))
        length = best[1]
        if length and length >= min(least, len(t)) and (best[0] + 3 * length) / 4 >= share * length:
            return True
    return False
