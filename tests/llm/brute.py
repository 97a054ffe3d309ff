"""Plain Python versions of the queries' results."""

import base64
import hashlib
import re
import zlib
from collections import defaultdict

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(s: str | bytes) -> str:
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def decontaminate(docs, bench):
    """docs: (doc_id, text); bench: (item_id, text). A set-based scan of every window."""
    pat = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: pat.findall((t or "").translate(LOW))
    wins = defaultdict(set)
    for item, text in bench:
        w = words(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            wins[tuple(w[i : i + 13])].add(str(item))
    sizes = {len(w) for w in wins}
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, items = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (found := wins.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    items |= found
        out.append((doc_id, len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def line_dedup(docs, least=20, many=3):
    key = lambda s: s.strip(" \t\n\x0b\f\r").translate(LOW)
    where = defaultdict(set)
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least and doc_id is not None:
                where[key(line)].add(doc_id)
    over = {k: max(v) for k, v in where.items() if len(v) >= many}
    out = []
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in over or over[key(x)] == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def chat(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn, role or "", text or ""))
    out = []
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        loss = "".join(t[2] for t in turns if t[1] == "assistant")
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss)))
    return out


def pii_base(text):
    t = text or ""
    spans = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    spans += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        s = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d[::-1]))
        if 13 <= len(d) <= 19 and s % 10 == 0:
            spans.append(("card", m.start(), m.end()))
    spans += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return [f"{k}:{a}:{b}" for k, a, b in spans]


def telephony(text):
    p = (text or "").encode()
    full = p + b"\xff" * (-len(p) % 576 or (0 if p else 576))
    return len(p), len(full), sha(full), zlib.crc32(full[-32:])


def mulaw(b):
    u = 255 - b
    x = ((u % 16) * 8 + 132) * 2 ** (u // 16 % 8) - 132
    return -x if u >= 128 else x


def upsampled(x):
    out = []
    for i, v in enumerate(x):
        out += [v, round((v + x[min(i + 1, len(x) - 1)]) / 2)]
    return out


def audio_feature(pcm):
    signs = sum((a < 0) != (b < 0) for a, b in zip(pcm, pcm[1:], strict=False))
    crc = zlib.crc32(b"".join(v.to_bytes(2, "little", signed=True) for v in pcm))
    return f"n={len(pcm)};peak={max(map(abs, pcm))};mean_abs={sum(map(abs, pcm)) // len(pcm)};sign_changes={signs};pcm_crc={crc}"


def warc(pages):
    first = {}
    for page, html in pages:
        b = (html or "").encode()
        if page is not None:
            first[b] = min(page, first.get(b, page))
    count = defaultdict(int)
    for _, html in pages:
        count[(html or "").encode()] += 1
    out = []
    for page, html in pages:
        b = (html or "").encode()
        again = count[b] > 1 and b in first and page != first[b]
        out.append((page, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first[b] if again else None))
    return out


def jaccard(docs, k=3, num=90, den=100):
    """Components over all pairs of different sets (inverted index, exact counts)."""
    sets = []
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset())
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    index, first = defaultdict(list), {}
    for i, s in enumerate(sets):
        if not s:
            continue
        if s in first:
            parent[root(i)] = root(first[s])
            continue
        first[s] = i
        both = defaultdict(int)
        for x in s:
            for j in index[x]:
                both[j] += 1
            index[x].append(i)
        for j, n in both.items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return [(d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))]
