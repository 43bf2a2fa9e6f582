"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter

import xxhash

SPACED = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return SPACED.findall((text or "").encode())


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def substring_dedup(texts, size=35):
    """Per text: words, removed words, hash of the kept words."""
    held = [words(t) for t in texts]
    seen = Counter(tuple(w[i:i + size]) for w in held for i in range(len(w) - size + 1))
    out = []
    for w in held:
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i:i + size])] > 1:
                gone.update(range(i, i + size))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def fingerprint(text):
    w = words(ascii_lower(text))
    if not w:
        return 0
    grams = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(items, linked):
    """Smallest item reachable from each by the relation."""
    root = {i: i for i in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in items}


def simhash(rows):
    """(doc_id, fingerprint hex, component) of rows with distinct ids."""
    prints = {i: fingerprint(t) for i, t in rows}
    ids = sorted(prints)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if (prints[a] ^ prints[b]).bit_count() <= 2]
    root = components(ids, links)
    return {(i, f"{prints[i]:016x}", root[i]) for i in ids}


FIM_UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^\n \t\x0b\x0c\r]*[\n \t\x0b\x0c\r]|[^\n \t\x0b\x0c\r]+",
             "sentence": r"[^\n.!?]*[\n.!?]|[^\n.!?]+"}


def fill_in_middle(doc_id, text, unit="line", rate=100):
    """(n, form, prefix_chars, middle_chars, output)"""
    text = text or ""
    units = re.findall(FIM_UNITS[unit], text)
    n = len(units)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def damage(rows):
    """Rows (conv_id, turn, role, text) with the faults put in."""
    out = []
    for conv, turn, role, text in rows:
        said = lambda x: " " if x is None else str(x)
        case = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        if case == 0:
            continue
        if case == 1:
            text = ""
        if case == 2:
            text = re.sub("[.!?]", "", text)
        if case == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if case == 3 else 1)
    return out


def repair(rows):
    """One conversation's rows (turn, role, text): gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired lines. Every cheapest path is
    kept at each place, so ties are told apart by whole audits."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults, seen = [], set()
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else
                      "truncated" if solid[-1] not in ".!?" else None)
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    legal = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}

    def add(to, role, cost, audit, lines):
        held = to.get(role)
        if held is None or (cost, audit) < held[:2]:
            to[role] = (cost, audit, lines)

    def put_in(at):
        for _ in range(3):  # more than two in a row never pay
            for last, (cost, audit, lines) in list(at.items()):
                role = "a" if last == "u" else "u"
                add(at, role, cost + 2, audit + "I", lines + [{"u": "user:", "a": "assistant:"}[role]])

    at = {"": (0, "", [])}
    put_in(at)
    for (_, role, text), fault in zip(rows, faults):
        to = {}
        for last, (cost, audit, lines) in at.items():
            add(to, last, cost + 3, audit + "D", lines)
            if fault in ("blank", "duplicate"):
                continue
            more = fault == "truncated"
            if (last, role[:1]) in legal:
                add(to, role[:1], cost + more, audit + "K", lines + [f"{role}:{text}"])
            for new in ("user", "assistant"):
                if (last, new[0]) in legal:
                    add(to, new[0], cost + 2 + more, audit + "R", lines + [f"{new}:{text}"])
        at = to
        put_in(at)
    cost, audit, lines = min((at[x] for x in ("", "a") if x in at), key=lambda x: x[:2])
    return (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, lines)
