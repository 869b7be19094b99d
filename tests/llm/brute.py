"""Plain Python versions of the operators' rules, for small tables."""

import hashlib
import itertools
import math
import re
import zlib

import numpy as np

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def least_reachable(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def embeddings(rows, similarity=0.98):
    """rows: (id, vector, label) -> {id: (n_links, component, kept)}"""
    usable = {}
    for key, v, label in rows:
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable[key] = (np.array(v, float), label)
    links = [
        (a, b) for a, b in itertools.combinations(usable, 2)
        if usable[a][1] == usable[b][1] and len(usable[a][0]) == len(usable[b][0]) and usable[a][0] @ usable[b][0] / np.sqrt((usable[a][0] @ usable[a][0]) * (usable[b][0] @ usable[b][0])) >= similarity
    ]
    part = least_reachable([r[0] for r in rows], links)
    return {k: (sum(k in pair for pair in links), part[k], part[k] == k) for k in part}


def contamination(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(_LOWER))
    windows = {}
    for key, text in items:
        w = words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(key))
    out = {}
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= got
        out[key] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def repeats(docs, length=50):
    data = {k: (t or "").encode() for k, t in docs}
    first = {}
    for key in sorted(data):
        for i in range(len(data[key]) - length + 1):
            first.setdefault(data[key][i : i + length], key)
    out = {}
    for key, d in data.items():
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if first[d[i : i + length]] < key:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[key] = (len(d), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(d, gone) if not g)).hexdigest())
    return out


def lines(docs, size=9, percent=80):
    """{id: (lines_total, removed places)}: exact, over all pairs of different lines."""
    def shingles(line):
        return frozenset(line[i : i + size] for i in range(max(1, len(line) - size + 1)))

    places, sets = {}, {}
    for key, text in docs:
        for i, line in enumerate((text or "").split("\n") if text is not None else []):
            if line.strip(" "):
                places.setdefault(line, []).append((key, i))
                sets[line] = shingles(line)
    index = {}
    for line, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(line)
    pairs = {}
    for group in index.values():
        for a, b in itertools.combinations(sorted(group), 2):
            pairs[a, b] = pairs.get((a, b), 0) + 1
    links = [(a, b) for (a, b), n in pairs.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    part = least_reachable(sets, links)
    first = {}
    for line, at in places.items():
        first[part[line]] = min([*at, first.get(part[line], min(at))])
    gone = {}
    for line, at in places.items():
        for key, i in at:
            if (key, i) != first[part[line]]:
                gone.setdefault(key, set()).add(i)
    return {key: (0 if text is None else len(text.split("\n")), gone.get(key, set())) for key, text in docs}


def base_spans(text):
    found = []
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found += [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text or "") if len(m[2]) >= 12]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 18]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text or "") if len(m[0]) >= 16]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(docs):
    """{id: (n_shingles, component)}"""
    sets = {k: shingle_set(t) for k, t in docs}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    part = least_reachable(sets, links)
    return {k: (len(sets[k]), part[k]) for k in sets}


def phrases(learned, text):
    """The number of phrases of a text (a string of symbols): each the longest match with the learned string from where it
    begins; a symbol that is not learned begins a phrase that goes on with the next match."""
    at = n = 0
    while at < len(text):
        begin = at + (text[at] not in learned)
        end = begin
        while end < len(text) and text[begin : end + 1] in learned:
            end += 1
        at, n = max(end, at + 1), n + 1
    return n


def best_path(emissions, moves):
    paths = itertools.product(range(3), repeat=len(emissions))
    return max(paths, key=lambda p: sum(e[t] for e, t in zip(emissions, p)) + sum(moves[a][b] for a, b in zip(p, p[1:])))


def vote(vectors, labels, own, neighbours):
    """The weighted share of label 1 among the nearest neighbours of one unit vector."""
    near = sorted(((float(v @ own), y) for v, y in zip(vectors, labels)), key=lambda x: -x[0])[:neighbours]
    weights = [max(c, 0) ** 8 for c, _ in near]
    return sum(w * y for w, (_, y) in zip(weights, near)) / sum(weights)


def prefix_trie(turns):
    """Rows (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of turns (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in sorted(((c, t, r or "", x or "") for c, t, r, x in turns if c is not None), key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2], x[3])):
        own.setdefault(c, []).append((role, text))
    heads = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    seqs = {c: tuple(own.get(c - int(math.fmod(c, 20)), [])[: heads[c]] + own[c][heads[c] :]) for c in own}
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) if node in kids else 1
        saved[node] = sum(saved[k] for k in kids.get(node, [])) + ((len(members[node]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0)
    out = []
    for node, ids in members.items():
        ends = ",".join(map(str, sorted(c for c in ids if len(seqs[c]) == len(node))))
        out.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(kids.get(node, [])), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0], r[3], r[7]))


def spelling_words(docs):
    """word -> n of docs (id, text), before the bounds."""
    counts = {}
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    return counts


def spelling_groups(counts):
    """Rows (word, form, root, n, n_near, form_n) of words and their counts."""
    holes, near = {}, {w: set() for w in counts}
    for w in counts:
        for i in range(len(w)):
            holes.setdefault((i, w[:i] + w[i + 1 :]), []).append(w)
            if (short := w[:i] + w[i + 1 :]) in counts:
                near[w].add(short)
                near[short].add(w)
    for group in holes.values():
        for w in group:
            near[w].update(x for x in group if x != w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= 2 * counts[w]:
            form[w] = best
    out = []
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, counts[w], len(near[w]), counts.get(form.get(w))))
    return sorted(out)
