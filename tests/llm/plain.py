"""Plain versions of the operators, row by row, to hold the Spark results against."""

import hashlib
import re
from collections import defaultdict

import xxhash

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def base_spans(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(spans)


IDENT = re.compile(r"""(?i:client_?id|access_?key(?:_?id)?|user(?:name)?|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", re.A)
ENDPOINT = re.compile(r"""https?://[^ \t\n\x0b\f\r"'<>]{4,}|(?i:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/_-]{4,}""", re.A)


def linked_spans(text, reach=200):
    """Spans by kind: base ones, and the weak ones beside their complements, every pair looked at."""
    found = {kind: [] for kind in ("assign", "access", "hex")}
    for start, k, end in base_spans(text):
        found[("assign", "access", "hex")[k]].append((start, end))
    base = [s for spans in found.values() for s in spans]
    meet = lambda a, b: a[0] < b[1] and b[0] < a[1]
    free = lambda spans, others: [s for s in spans if not any(meet(s, o) for o in others)]
    every = {"ident": [m.span() for m in IDENT.finditer(text)], "endpoint": [m.span() for m in ENDPOINT.finditer(text)]}
    every["weak"] = [
        m.span() for m in re.finditer("[A-Za-z0-9+/_-]{20,}", text) if all(re.search(c, m[0]) for c in ("[A-Z]", "[a-z]", "[0-9]"))
    ]
    every = {k: free(v, base + every["endpoint"] if k == "weak" else base) for k, v in every.items()}
    breaks = [m.end() for m in re.finditer("\n[ \t\r]*\n", text)]
    scope = lambda s: sum(b <= s[0] for b in breaks)

    def near(a, others):
        return any(scope(a) == scope(b) and not meet(a, b) and b[1] + reach >= a[0] and b[0] <= a[1] + reach for b in others)

    identifiers, parts = found["access"] + every["ident"], found["assign"] + found["hex"] + every["weak"]
    found["ident"] = [s for s in every["ident"] if near(s, parts)]
    found["weak"] = [s for s in every["weak"] if near(s, identifiers)]
    found["endpoint"] = [s for s in every["endpoint"] if near(s, identifiers) and near(s, parts)]
    return found


def masked(text, spans, mark="[secret]"):
    out, at, held = [], 0, None
    for start, end in sorted(spans):
        if held is None or start > held:
            out.append(text[at:start] + mark)
            held = end
        at = held = max(held, end)
    return "".join(out) + text[at:]


def secrets_row(text):
    spans = base_spans(text)
    kinds = ("assign", "access", "hex")
    listed = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)
    return [sum(k == i for _, k, _ in spans) for i in range(3)], listed


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def item_windows(benchmark, width=10):
    windows = defaultdict(set)
    for item, text in benchmark:
        words = WORD.findall(ascii_lower(text or ""))
        size = min(width, len(words))
        for k in range(len(words) - size + 1) if size else ():
            windows[tuple(words[k : k + size])].add(item)
    return windows


def contamination(text, windows):
    words = WORD.findall(ascii_lower(text or ""))
    hit, items = set(), set()
    for size in {len(w) for w in windows}:
        for k in range(len(words) - size + 1):
            ids = windows.get(tuple(words[k : k + size]))
            if ids:
                hit.update(range(k, k + size))
                items |= ids - {None}
    return len(words), len(hit), len(items), sha(",".join(sorted(map(str, items))))


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))
    if not words:
        return 0
    runs = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_components(rows, bits=3):
    """(doc_id, fingerprint) to {fingerprint: component}, by comparing all pairs."""
    fps = sorted({f for _, f in rows})
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= bits:
                parent[root(a)] = root(b)
    low = {}
    for d, f in rows:
        if d is not None:
            low[root(f)] = min(d, low.get(root(f), d))
    return {f: low.get(root(f)) for f in fps}


def edited_half(text, other):
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]
